"""From request terms to query words: normalising, classifying, grouping, choosing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findery.functions import fields as X, text as T
from findery.rules import FieldRule, RuleSet, text_array

# Fields searched when an index says nothing about itself.
FALLBACK_FIELDS = (X.NODE_NAME, X.SYSTEM_NODE_NAME)


def normalize_terms(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("normalized_term", T.normalize_term(F.col(col)))


def kept_words(term: Column, stop_words: tuple[str, ...]) -> Column:
    """Words of a term in order, stop words left out ignoring case."""
    stops = text_array(stop_words)
    return F.filter(
        F.split(term, "[ \t\n\r]+"), lambda w: (w != "") & ~F.array_contains(stops, F.lower(w))
    )


def _synonym_map(synonyms: tuple[tuple[str, str], ...]) -> Column:
    groups: dict[str, list[str]] = {}
    for word, other in synonyms:
        if other.strip():
            groups.setdefault(word.strip().lower(), []).append(other)
    if not groups:
        return F.create_map().cast("map<string,array<string>>")
    parts = [x for w, others in groups.items() for x in (F.lit(w), text_array(others, lower=False))]
    return F.create_map(*parts)


def term_groups(
    queries: DataFrame, stop_words: tuple[str, ...] = (), synonyms: tuple[tuple[str, str], ...] = (),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per word and synonym: (query_id, group_no, variant_no, variant) and carried columns."""
    none = F.array().cast("array<string>")
    # A plan's expansions belong to the whole term, so only a one-word term meets them.
    planned = F.coalesce("expansions", none) if "expansions" in queries.columns else none
    words = queries.select(
        "query_id", *carry, planned.alias("planned"), F.lower(F.trim("term")).alias("whole"),
        F.posexplode(kept_words(F.col("term"), stop_words)).alias("group_no", "word"),
    )
    others = F.array_distinct(F.concat(
        F.coalesce(F.try_element_at(_synonym_map(synonyms), F.lower("word")), none),
        F.when(F.lower("word") == F.col("whole"), F.col("planned")).otherwise(none),
    ))
    return words.select(
        "query_id", *carry, "group_no",
        F.posexplode(F.concat(F.array("word"), others)).alias("variant_no", "variant"),
    )


def _available(catalogue: DataFrame, column: str) -> Column:
    """Distinct lower-cased names of the (schema-sized) catalogue, as a scalar subquery."""
    return catalogue.agg(F.collect_set(F.lower(column))).scalar()


def classify_queries(queries: DataFrame, rules: RuleSet, catalogue: DataFrame) -> DataFrame:
    """Adds ``status``: ``ok`` or the first reason a query cannot run."""
    term = F.regexp_replace(F.coalesce("term", F.lit("")), f"^[{T.SPACE}]+|[{T.SPACE}]+$", "")
    browse = F.col("allow_empty") & (term == "")
    blocked = F.array_contains(text_array(rules.blocked_terms), F.lower(term))
    any_index = F.arrays_overlap(
        _available(catalogue, "index_name"), text_array(rules.index_names)
    ) if rules.index_names else F.size(_available(catalogue, "index_name")) > 0
    included = bool(rules.include_content_types or rules.include_media_types or rules.include_members)
    names = [f.name.strip().lower() for f in rules.fields if f.enabled and f.name.strip()] or list(FALLBACK_FIELDS)
    cultures = F.when(F.size("cultures") > 0, F.col("cultures")).otherwise(
        text_array(rules.cultures, lower=False)
    )
    wanted = F.flatten(F.transform(
        text_array(names),
        lambda n: F.concat(F.array(n), F.transform(cultures, lambda c: F.concat(n, F.lit("_"), F.lower(c)))),
    ))
    if any(f.enabled and f.name.strip() for f in rules.fields):
        has_field = F.arrays_overlap(_available(catalogue, "field"), wanted)
    else:
        has_field = F.lit(True)
    return queries.withColumn(
        "status",
        F.when((term == "") & ~browse, "empty")
        .when(~browse & (F.length(term) < max(1, rules.minimum_length)), "too_short")
        .when(~browse & blocked, "blocked_term")
        .when(~browse & (F.size(kept_words(term, rules.stop_words)) == 0), "all_stop_words")
        .when(~any_index, "no_index")
        .when(F.lit(not included), "nothing_included")
        .when(~browse & ~has_field, "no_field")
        .otherwise("ok"),
    )


def resolve_field_rules(catalogue: DataFrame, field_rules: tuple[FieldRule, ...]) -> DataFrame:
    """(index_name, field, boost, match_mode) searched in each index.

    Configured fields when there are any; otherwise every searchable field the index exposes,
    names at 10, titles at 5, the rest at 1; an index exposing none is searched by node name.
    """
    indexes = catalogue.groupBy("index_name").agg(
        F.collect_set(F.when(F.col("is_searchable"), F.col("field"))).alias("searchable")
    )
    return indexes.select("index_name", F.inline(_rules_of(F.col("searchable"), field_rules)))


def discovered_boost(field: Column) -> Column:
    """The weight of a field that no rule names: names at 10, titles at 5, others at 1."""
    name = field.isin(X.NODE_NAME, X.SYSTEM_NODE_NAME) | field.startswith(X.NODE_NAME + "_")
    return F.when(name, F.lit(10.0)).when(field.rlike("(title|heading|headline)$"), F.lit(5.0)).otherwise(F.lit(1.0))


def _rules_of(searchable: Column, field_rules: tuple[FieldRule, ...]) -> Column:
    """The rules of one index as an array; ``searchable`` counts only where none are configured."""
    configured = [r for r in field_rules if r.enabled and r.name.strip()]

    def rule_struct(name: str, boost: float, mode: str) -> Column:
        return F.struct(
            F.lit(name.strip().lower()).alias("field"), F.lit(float(boost)).alias("boost"),
            F.lit(mode).alias("match_mode"),
        )

    if configured:
        return F.array(*[rule_struct(r.name, r.boost, r.match_mode) for r in configured])
    discovered = F.transform(
        F.array_sort(searchable),
        lambda f: F.named_struct(
            F.lit("field"), f, F.lit("boost"), discovered_boost(f), F.lit("match_mode"), F.lit("prefix")
        ),
    )
    fallback = F.array(*[rule_struct(n, 1.0, "prefix") for n in FALLBACK_FIELDS])
    return F.when(F.size(searchable) > 0, discovered).otherwise(fallback)


def culture_fields(field: Column, cultures: Column, available: Column) -> Column:
    """The culture variants of a field the index has, else the plain field."""
    variants = F.transform(cultures, lambda c: F.concat(field, F.lit("_"), F.lower(c)))
    present = F.filter(F.array_distinct(variants), lambda v: F.array_contains(available, v))
    return F.when((F.size(present) > 0) & ~field.startswith("__"), present).otherwise(F.array(field))


def expand_cultures(fields: DataFrame, cultures: tuple[str, ...], catalogue: DataFrame) -> DataFrame:
    """Field rules with each field replaced by the variants of the wanted cultures it has."""
    available = catalogue.groupBy("index_name").agg(F.collect_set("field").alias("available"))
    wanted = text_array(cultures)
    return (
        fields.join(available, "index_name")
        .withColumn("field", F.explode(culture_fields(F.col("field"), wanted, F.col("available"))))
        .drop("available").distinct()
    )


def search_fields(queries: DataFrame, rules: RuleSet, stats: DataFrame) -> DataFrame:
    """Every row of ``queries`` (with its ``cultures``) for every field it searches.

    Adds index_name, field, boost, match_mode, rule_no and n_fields, the number of rules times fields in that
    index. Two rules on one field are two searches of it, told apart by ``rule_no``.

    What an index offers comes from its (schema-sized) field statistics as one scalar map, so the
    choice is made inside each query's row. Request cultures override those of the rules. Without configured
    fields, those marked ``is_searchable`` are searched.
    """
    searchable = F.col("is_searchable") if "is_searchable" in stats.columns else F.lit(True)
    per_index = stats.groupBy("index_name").agg(
        F.collect_set("field").alias("fields"), F.collect_set(F.when(searchable, F.col("field"))).alias("searchable"),
    )
    entry = F.struct("index_name", F.struct("fields", "searchable").alias("offer"))
    offered = per_index.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    cultures = F.when(F.size("cultures") > 0, F.col("cultures")).otherwise(
        text_array(rules.cultures, lower=False)
    )

    def resolved(offer: Column) -> Column:
        expanded = F.flatten(F.transform(_rules_of(offer["searchable"], rules.fields), lambda r, i: F.transform(
            culture_fields(r["field"], F.col("wanted_cultures"), offer["fields"]),
            lambda f: F.named_struct(
                F.lit("field"), f, F.lit("boost"), r["boost"], F.lit("match_mode"), r["match_mode"], F.lit("rule_no"), i,
            ),
        )))
        return F.filter(expanded, lambda r: F.array_contains(offer["fields"], r["field"]))

    kept = [c for c in queries.columns if c != "cultures"]
    chosen = queries.select(*kept, cultures.alias("wanted_cultures"), F.explode(offered).alias("index_name", "offer"))
    if rules.index_names:
        chosen = chosen.filter(F.lower("index_name").isin([n.lower() for n in rules.index_names]))
    chosen = chosen.select(*kept, "index_name", resolved(F.col("offer")).alias("chosen"))
    return chosen.select(*kept, "index_name", F.size("chosen").alias("n_fields"), F.inline("chosen"))
