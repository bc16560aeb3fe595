"""Model replies that arrive as a table: reading, checking, applying and describing query plans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from findery.operators.rank import reply_object
from findery.rules import Facet, SortOption, lookup, text_array

# What a plan may hold at most.
MAX_TERM, MAX_EXPANSIONS, MAX_EXPANSION, MAX_FILTERS, MAX_VALUES, MAX_VALUE, MAX_SORT = 300, 6, 60, 3, 3, 80, 80

TEXTS = "array<string>"
FILTERS = "map<string,array<string>>"


@dataclass(frozen=True)
class PlanSwitches:
    correct_spelling: bool = True
    expand_synonyms: bool = True
    extract_filters: bool = True


def _text(value: Column, longest: int) -> Column:
    """A JSON string, trimmed, if it has 1 to ``longest`` characters; null for other values."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
    return F.when((F.length(text) > 0) & (F.length(text) <= longest), text)


def _unique(values: Column, most: int) -> Column:
    """Usable texts, repeats dropped ignoring case, the first ``most``."""
    kept = F.array_compact(values)
    firsts = F.filter(kept, lambda v, i: ~F.exists(
        F.slice(kept, F.lit(1), i), lambda earlier: F.lower(earlier) == F.lower(v)
    ))
    return F.slice(F.coalesce(firsts, F.array().cast(TEXTS)), 1, most)


def _filter_values(value: Column) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    single = F.array(_text(value, MAX_VALUE))
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    listed = F.transform(items, lambda v: _text(v, MAX_VALUE))
    return _unique(F.when(is_list, listed).otherwise(single), MAX_VALUES)


def parse_plan_replies(replies: DataFrame, switches: PlanSwitches = PlanSwitches()) -> DataFrame:
    """(query_id, term, expansions, filters, sort) from the first object in a reply.

    Values of the wrong kind or length are dropped one by one; a plan with nothing left is no row.
    """
    shape = "term variant, expansions array<variant>, filters map<string,variant>, sort variant"
    plan = replies.select("query_id", F.from_json(reply_object(F.col("reply")), shape).alias("p"))
    term = _text(F.col("p.term"), MAX_TERM) if switches.correct_spelling else F.lit(None)
    expansions = _unique(
        F.transform("p.expansions", lambda v: _text(v, MAX_EXPANSION)), MAX_EXPANSIONS
    ) if switches.expand_synonyms else F.array()
    filters = F.transform_values("p.filters", lambda k, v: _filter_values(v)) if switches.extract_filters else F.lit(None)
    sort = _text(F.col("p.sort"), MAX_SORT) if switches.extract_filters else F.lit(None)
    return drop_empty(plan.select(
        "query_id", F.coalesce(term, F.lit("")).alias("term"), expansions.cast(TEXTS).alias("expansions"),
        F.coalesce(filters.cast(FILTERS), F.create_map().cast(FILTERS)).alias("filters"),
        sort.cast("string").alias("sort"),
    ))


def drop_empty(plans: DataFrame) -> DataFrame:
    return plans.filter(
        (F.col("term") != "") | (F.size("expansions") > 0) | (F.size(F.map_keys("filters")) > 0)
        | F.col("sort").isNotNull()
    )


def _canonical(values: Column, names: Sequence[str]) -> Column:
    """Values replaced by the configured spelling; unknown ones dropped."""
    known = {n.lower(): n for n in reversed(names) if n.strip()}
    return F.array_compact(F.transform(values, lambda v: lookup(v, known, "string")))


def validate_plan_filters(
    plans: DataFrame, facets: Sequence[Facet], sort_options: Sequence[SortOption]
) -> DataFrame:
    """Plans cut down to what the profile offers: enabled facets, their buckets, enabled sorts."""
    enabled = {f.alias.lower(): f for f in reversed(facets) if f.enabled and f.alias.strip()}
    aliases = {a: f.alias for a, f in enabled.items()}

    def checked(entry: Column) -> Column:
        values = entry["value"]
        for alias, facet in enabled.items():
            if facet.kind != "field":
                buckets = _canonical(entry["value"], [r.alias for r in facet.ranges])
                values = F.when(F.lower(entry["key"]) == alias, buckets).otherwise(values)
        return F.named_struct(F.lit("alias"), lookup(entry["key"], aliases, "string"), F.lit("values"), values)

    known = F.filter(
        F.transform(F.map_entries("filters"), checked),
        lambda e: e["alias"].isNotNull() & (F.size(e["values"]) > 0),
    )
    once = F.filter(known, lambda e, i: ~F.exists(
        F.slice(known, i + 2, F.size(known)), lambda later: later["alias"] == e["alias"]
    ))
    sorts = {o.alias.lower(): o.alias for o in reversed(sort_options) if o.enabled and o.alias.strip()}
    return drop_empty(plans.withColumns({
        "filters": F.map_from_entries(F.slice(once, 1, MAX_FILTERS)),
        "sort": lookup(F.col("sort"), sorts, "string"),
    }))


def apply_query_plan(queries: DataFrame, plans: DataFrame) -> DataFrame:
    """Queries as their plans rewrite them; what a visitor chose always wins.

    Expansions become synonyms of the whole rewritten term, so they act on one-word terms only.
    """
    plan = plans.select(
        "query_id", F.col("term").alias("_term"), F.col("expansions").alias("expansions"),
        F.col("filters").alias("_filters"), F.col("sort").alias("_sort"),
    )
    rows = queries.drop("expansions").join(plan, "query_id", "left")
    own = F.transform(F.map_keys("filters"), lambda k: F.lower(k))
    added = F.map_filter(
        F.coalesce("_filters", F.create_map().cast(FILTERS)), lambda k, v: ~F.array_contains(own, F.lower(k))
    )
    return rows.withColumns({
        "term": F.coalesce(F.nullif(F.col("_term"), F.lit("")), F.col("term")),
        "filters": F.map_concat("filters", added),
        "sort": F.coalesce(F.nullif(F.trim("sort"), F.lit("")), F.col("_sort")),
        "expansions": F.coalesce("expansions", F.array().cast(TEXTS)),
    }).drop("_term", "_filters", "_sort")


def describe_plans(plans: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """(query_id, description, filters_label): what a plan does, in words."""
    entries = F.map_entries("filters")
    facet_labels = {f.alias: f.label for f in reversed(facets) if f.label.strip()}
    buckets = {
        f"{f.alias}\u0001{r.alias}": r.label for f in reversed(facets) for r in reversed(f.ranges) if r.label
    }

    def labelled(entry: Column) -> Column:
        values = F.transform(entry["value"], lambda v: F.coalesce(
            lookup(F.concat_ws("\u0001", entry["key"], v), buckets, "string"), v
        ))
        label = F.coalesce(lookup(entry["key"], facet_labels, "string"), entry["key"])
        return F.concat(label, F.lit(": "), F.array_join(values, ", "))

    parts = F.array_compact(F.concat(
        F.array(
            F.when(F.col("term") != "", F.concat(F.lit('term rewritten to "'), F.col("term"), F.lit('"'))),
            F.when(F.size("expansions") > 0, F.concat(F.lit("expanded with "), F.array_join("expansions", ", "))),
        ),
        F.transform(entries, lambda e: F.concat(F.lit("filter "), e["key"], F.lit("="), F.array_join(e["value"], "|"))),
        F.array(F.concat(F.lit("sorted by "), F.col("sort"))),
    ))
    text = F.when(F.size(parts) == 0, "nothing to apply").otherwise(F.array_join(parts, "; "))
    return plans.select(
        "query_id", text.alias("description"), F.array_join(F.transform(entries, labelled), "; ").alias("filters_label")
    )
