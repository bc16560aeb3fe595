"""Facets: what values and buckets rows fall in, filtering by them, counting them.

A facet's rules are written into one array expression per row, so ranges need no join; counting
explodes a row's own values and aggregates them with map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.functions import dates as D, fields as X
from findery.functions.text import let
from findery.rules import Facet, FacetRange, rule_frame, text_array

NO_TEXTS = "array<string>"
# How a picked node may be written, and the facet fields read as a place in the tree
# or as a content type.
NODE_URI = "(?i)^umb://(document|media)/"
PLACE_FIELDS = {"__path", "path", "__key", "key", "__nodeid", "id"}
TYPE_FIELDS = {"__nodetypealias", "contenttypealias", "contenttype"}


def tokens_of(value: Column) -> Column:
    """A stored value cut at comma, semicolon and bar; trimmed, blanks dropped."""
    parts = F.transform(F.split(value, "[,;|]"), lambda v: F.trim(v))
    return F.coalesce(F.array_remove(parts, ""), F.array().cast(NO_TEXTS))


def _within(value: Column, bounds: Column) -> Column:
    return (
        value.isNotNull()
        & (bounds["lower"].isNull() | (value >= bounds["lower"]))
        & (bounds["upper"].isNull() | (value < bounds["upper"]))
    )


def _fixed_bounds(facet: Facet, as_of: str | None) -> list[tuple[str, Column]]:
    """Each bucket's alias with struct(lower, upper), as constants.

    Bounds come from the rules alone, so they are worked out once, over no table, and enter the
    plan as literals instead of being read again for every row.
    """
    numeric = facet.kind == "numeric"
    kind = "double" if numeric else D.NTZ

    alias, label, from_, to = (F.col(c) for c in ("alias", "label", "from_bound", "to_bound"))
    if numeric:
        lower, upper = D.parse_number(from_), D.parse_number(to)
        inferred = D.inferred_numbers(alias, label)
    else:
        lower, upper = D.date_bound(from_, as_of), D.date_bound(to, as_of)
        inferred = D.inferred_dates(alias, label, as_of)
    rows = [(r.alias, r.label, r.from_bound, r.to_bound) for r in facet.ranges]
    rules = rule_frame(rows, ("alias", "label", "from_bound", "to_bound"))
    read = rules.select(lower.alias("lower"), upper.alias("upper"), inferred.alias("inferred"))
    open_ended = F.col("lower").isNull() & F.col("upper").isNull()
    bounds = read.select(*[
        F.when(open_ended, F.col(f"inferred.{c}")).otherwise(F.col(c)).cast("string").alias(c)
        for c in ("lower", "upper")
    ]).collect()
    return [
        (r.alias, F.struct(F.lit(b["lower"]).cast(kind).alias("lower"), F.lit(b["upper"]).cast(kind).alias("upper")))
        for r, b in zip(facet.ranges, bounds)
    ]


def infer_numeric_bounds(ranges: DataFrame) -> DataFrame:
    """Adds ``lower`` and ``upper`` read from each bucket's alias and label."""
    return ranges.select("*", D.inferred_numbers(F.col("alias"), F.col("label")).alias("b")).select("*", "b.*").drop("b")


def infer_date_bounds(ranges: DataFrame, as_of: str) -> DataFrame:
    bounds = D.inferred_dates(F.col("alias"), F.col("label"), as_of)
    return ranges.select("*", bounds.alias("b")).select("*", "b.*").drop("b")


def relative_date_bounds(ranges: DataFrame, as_of: str) -> DataFrame:
    """Adds ``lower`` and ``upper`` from the written bounds."""
    return ranges.withColumns({
        "lower": D.date_bound(F.col("from_bound"), as_of), "upper": D.date_bound(F.col("to_bound"), as_of),
    })


def facet_date(field: str) -> Column:
    """The first readable date of the facet's field, the update date and the create date."""
    candidates = [] if field.lower() == "score" else [X.facet_value(field)]
    stamps = [
        F.coalesce(X.stored(X.UPDATE_DATE), F.col("update_date")),
        F.coalesce(X.stored(X.CREATE_DATE), F.col("create_date")),
    ]
    return F.coalesce(*[D.parse_date(c) for c in candidates + stamps])


def _target(r: FacetRange) -> str:
    return (r.from_bound.strip() or r.alias.strip()).lower()


def _node_text(target: Column) -> Column:
    bare = F.regexp_replace(F.lower(target), NODE_URI, "")
    return F.when(F.lower(target).rlike(NODE_URI), F.replace(bare, F.lit("-"), F.lit(""))).otherwise(bare)


def resolved_nodes(ranges: Sequence[FacetRange], node_keys: DataFrame | None) -> Column:
    """Map of a bucket's target key to its node id, for the few targets of the rules."""
    if node_keys is None:
        return F.create_map().cast("map<string,string>")
    wanted = F.transform(text_array([_target(r) for r in ranges]), lambda t: F.replace(_node_text(t), F.lit("-"), F.lit("")))
    key = F.replace(F.lower("node_key"), F.lit("-"), F.lit(""))
    entry = F.struct(key.alias("key"), F.col("node_id").cast("string").alias("id"))
    found = node_keys.filter(F.array_contains(wanted, key)).agg(F.map_from_entries(F.collect_set(entry)))
    return found.scalar()


def _own_ids() -> Column:
    """A row's id and path segments, as text."""
    return F.concat(
        F.array(F.col("node_id").cast("string")),
        F.coalesce(F.col("path").cast(NO_TEXTS), F.array().cast(NO_TEXTS)),
    )


def _own_places() -> Column:
    """Every way a row may be named as a place: key, id and path segments."""
    key = F.lower("doc_key")
    return F.concat(F.array(key, F.replace(key, F.lit("-"), F.lit(""))), _own_ids())


def _pick(tests: Sequence[tuple[str, Column]]) -> Column:
    """Aliases whose test holds, in rule order."""
    picked = F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(a)) for a, t in tests]).cast(NO_TEXTS)
    return F.array_compact(picked)


def memberships(facet: Facet, as_of: str | None = None, node_keys: DataFrame | None = None) -> Column:
    """The facet values of a row: its tokens, or the aliases of the buckets it falls in.

    A facet with ranges is a range facet whatever its kind says; the kind only chooses how a
    range is tested.
    """
    target = facet.target
    raw = X.facet_value(target)
    if not facet.ranges:
        return tokens_of(raw)
    if facet.kind == "numeric":
        return let(D.parse_number(raw), lambda v: _pick([
            (alias, _within(v, bounds)) for alias, bounds in _fixed_bounds(facet, as_of)
        ]))
    if facet.kind == "dateRange":
        return let(facet_date(target), lambda v: _pick([
            (alias, _within(v, bounds)) for alias, bounds in _fixed_bounds(facet, as_of)
        ]))
    if target.lower() in PLACE_FIELDS:
        known, tests = resolved_nodes(facet.ranges, node_keys), []
        for r in facet.ranges:
            text = _node_text(F.lit(_target(r)))
            id_ = F.try_element_at(known, F.replace(text, F.lit("-"), F.lit("")))
            hit = F.array_contains(_own_places(), text) | F.coalesce(F.array_contains(_own_ids(), id_), F.lit(False))
            tests.append((r.alias, hit & F.lit(bool(_target(r)))))
        return _pick(tests)
    value = F.lower("type_alias") if target.lower() in TYPE_FIELDS else F.lower(raw)
    return let(value, lambda v: _pick([
        (r.alias, v.isin({_target(r), r.alias.strip().lower()} - {""})) for r in facet.ranges
    ]))


def _adhoc(facet: Facet, chosen: Column, as_of: str | None, known_ids: Column) -> Column:
    """Whether a row falls in any bucket named by the selection alone."""
    raw = X.facet_value(facet.target)
    if facet.kind == "numeric":
        number = D.parse_number(raw)
        return F.exists(chosen, lambda v: _within(number, D.inferred_numbers(v, v)))
    if facet.kind == "dateRange":
        date = facet_date(facet.target)
        return F.exists(chosen, lambda v: _within(date, D.inferred_dates(v, v, as_of)))
    if facet.target.lower() in PLACE_FIELDS:
        texts = F.transform(chosen, _node_text)
        return F.arrays_overlap(_own_places(), texts) | F.arrays_overlap(_own_ids(), known_ids)
    value = F.lower("type_alias") if facet.target.lower() in TYPE_FIELDS else F.lower(raw)
    return F.array_contains(chosen, value)


def lower_filters(filters: Column) -> Column:
    """Selections by lower-cased alias, empty ones dropped, values lower-cased."""
    kept = F.map_filter(filters, lambda k, v: F.size(v) > 0)
    lowered = F.transform(F.map_entries(kept), lambda e: F.named_struct(
        F.lit("alias"), F.lower(e["key"]), F.lit("chosen"), F.transform(e["value"], lambda v: F.lower(v))
    ))
    return F.map_from_entries(lowered)


def _chosen(facet: Facet) -> Column:
    return F.try_element_at(F.col("_filters"), F.lit(facet.alias.lower()))


def _missing(facet: Facet) -> Column:
    return F.array_except(text_array(facet.requires), F.map_keys("_filters"))


def _passes(facet: Facet, values: Column, as_of: str | None, known_ids: Column) -> Column:
    chosen = _chosen(facet)
    lowered = F.transform(values, lambda v: F.lower(v))
    if facet.ranges:
        known = text_array([r.alias for r in facet.ranges])
        hit = F.when(
            F.arrays_overlap(known, chosen), F.arrays_overlap(lowered, chosen)
        ).otherwise(_adhoc(facet, chosen, as_of, known_ids))
    else:
        # The whole stored value may be selected, even when its tokens are not.
        raw = F.lower(X.facet_value(facet.target))
        hit = F.arrays_overlap(lowered, chosen) | F.coalesce(F.array_contains(chosen, raw) & (raw != ""), F.lit(False))
    inert = chosen.isNull() | (F.size(_missing(facet)) > 0)
    return inert | F.coalesce(hit, F.lit(False))


def _chosen_nodes(chosen: DataFrame, facet: Facet, node_keys: DataFrame) -> DataFrame:
    """(query_id, ids) of the nodes a place facet's selected keys stand for."""
    key = F.replace(_node_text(F.col("value")), F.lit("-"), F.lit(""))
    selected = chosen.select("query_id", F.explode(_chosen(facet)).alias("value")).select("query_id", key.alias("key"))
    known = node_keys.select(
        F.replace(F.lower("node_key"), F.lit("-"), F.lit("")).alias("key"), F.col("node_id").cast("string").alias("id")
    )
    return selected.join(known, "key").groupBy("query_id").agg(F.collect_set("id").alias("ids"))


def _with_passes(
    hits: DataFrame, queries: DataFrame, facets: Sequence[Facet], as_of: str | None, node_keys: DataFrame | None
) -> DataFrame:
    """Adds per facet i: ``_v{i}`` (its values) and ``_p{i}`` (passes its selection)."""
    chosen = queries.select("query_id", lower_filters(F.col("filters")).alias("_filters"))
    none = F.array().cast(NO_TEXTS)
    known_ids = {}
    for i, facet in enumerate(facets):
        if node_keys is not None and facet.ranges and facet.target.lower() in PLACE_FIELDS:
            nodes = _chosen_nodes(chosen.select("query_id", "_filters"), facet, node_keys)
            chosen = chosen.join(nodes.withColumnRenamed("ids", f"_k{i}"), "query_id", "left")
            known_ids[i] = F.coalesce(f"_k{i}", none)
    rows = hits.join(chosen, "query_id")
    rows = rows.withColumns({f"_v{i}": memberships(f, as_of, node_keys) for i, f in enumerate(facets)})
    return rows.withColumns({
        f"_p{i}": _passes(f, F.col(f"_v{i}"), as_of, known_ids.get(i, none)) for i, f in enumerate(facets)
    })


def _helpers(facets: Sequence[Facet]) -> list[str]:
    return ["_filters", *[f"_{c}{i}" for i in range(len(facets)) for c in "vpk"]]


def _enabled(facets: Sequence[Facet]) -> list[Facet]:
    return [f for f in facets if f.enabled and f.alias.strip()]


def apply_facet_filters(
    hits: DataFrame, queries: DataFrame, facets: Sequence[Facet], min_active: int = 0, *,
    as_of: str | None = None, node_keys: DataFrame | None = None,
) -> DataFrame:
    """Rows passing every facet's selection; any value within a facet will do.

    Below ``min_active`` selections nothing narrows.
    """
    facets = _enabled(facets)
    if not facets:
        return hits
    rows = _with_passes(hits, queries, facets, as_of, node_keys)
    keep = F.lit(True)
    for i in range(len(facets)):
        keep = keep & F.col(f"_p{i}")
    if min_active > 0:
        keep = keep | (F.size(F.map_keys("_filters")) < min_active)
    return rows.filter(keep).drop(*_helpers(facets))


def facet_counts(
    hits: DataFrame, facet: Facet, *, as_of: str | None = None, node_keys: DataFrame | None = None
) -> DataFrame:
    """(query_id, value, n) of one facet over the given rows, zero buckets included."""
    rows = hits.select(
        "query_id", _order().alias("_order"), F.explode(memberships(facet, as_of, node_keys)).alias("value"),
    )
    counted = rows.withColumn("n", F.lit(1))
    if facet.ranges:
        counted = counted.unionByName(
            _zero_buckets(hits.select("query_id").distinct(), [facet]), allowMissingColumns=True
        )
    grouped = _count(counted.withColumn("facet", F.lit(facet.alias)))
    return _top(grouped, [facet]).drop("facet")


def _order() -> Column:
    """Rank as one ascending number: best bets, then the score."""
    return F.when(F.col("is_best_bet"), F.lit(float("-inf"))).otherwise(-F.col("score"))


def _zero_buckets(query_ids: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    pairs = [F.struct(F.lit(f.alias).alias("facet"), F.lit(r.alias).alias("value")) for f in facets for r in f.ranges]
    zero = query_ids.select("query_id", F.inline(F.array(*pairs)))
    return zero.withColumn("n", F.lit(0))


def _count(rows: DataFrame) -> DataFrame:
    """Uses per value ignoring case, shown in the spelling of its best-ranked row.

    Spellings are counted first, with numbers only in the buffers; what is left is small.
    """
    spelled = rows.groupBy("query_id", "facet", "value").agg(F.sum("n").alias("n"), F.min("_order").alias("_order"))
    best = F.struct(F.col("_order").isNull(), "_order", "value")
    return spelled.groupBy("query_id", "facet", F.lower("value").alias("_lower")).agg(
        F.min_by("value", best).alias("value"), F.sum("n").alias("n")
    ).drop("_lower")


def _top(grouped: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """Field facets keep their most frequent values, all without a limit; range facets keep all buckets."""
    limits = {f.alias.lower(): f.max_values for f in facets if not f.ranges and f.max_values > 0}
    if not limits:
        return grouped
    parts = [x for a, n in limits.items() for x in (F.lit(a), F.lit(n))]
    limit = F.try_element_at(F.create_map(*parts), F.lower("facet"))
    order = Window.partitionBy("query_id", "facet").orderBy(F.desc("n"), F.lower("value"))
    # The widest limit bounds every group before the shuffle; each facet's own follows.
    numbered = grouped.withColumn("_n", F.row_number().over(order))
    widest = max(limits.values())
    ranged = [f.alias for f in facets if f.ranges]
    if not ranged:
        numbered = numbered.filter(F.col("_n") <= widest)
    return numbered.filter(F.col("_n") <= F.coalesce(limit, F.col("_n"))).drop("_n")


def facet_field(hits: DataFrame, facet: Facet) -> DataFrame:
    """Token occurrences per value, ignoring case, the most frequent first ``max_values``."""
    return facet_counts(hits, facet)


def facet_numeric_range(hits: DataFrame, facet: Facet) -> DataFrame:
    return facet_counts(hits, facet)


def facet_date_range(hits: DataFrame, facet: Facet, as_of: str) -> DataFrame:
    return facet_counts(hits, facet, as_of=as_of)


def facet_subtree(hits: DataFrame, facet: Facet, node_keys: DataFrame | None = None) -> DataFrame:
    return facet_counts(hits, facet, node_keys=node_keys)


def facet_type_bucket(hits: DataFrame, facet: Facet) -> DataFrame:
    return facet_counts(hits, facet)


def facet_value_bucket(hits: DataFrame, facet: Facet) -> DataFrame:
    return facet_counts(hits, facet)


def facet_counts_excluding_self(
    hits: DataFrame, queries: DataFrame, facets: Sequence[Facet], *,
    as_of: str | None = None, node_keys: DataFrame | None = None,
) -> DataFrame:
    """Every facet counted over the rows passing all other facets' selections, in one pass.

    A row counts for a facet when it fails nothing, or fails that facet only.
    """
    facets = _enabled(facets)
    rows = _with_passes(hits, queries, facets, as_of, node_keys)
    failed = sum((F.when(F.col(f"_p{i}"), 0).otherwise(1) for i in range(len(facets))), F.lit(0))
    rows = rows.withColumn("_failed", failed)

    def counted_values(i: int, facet: Facet) -> Column:
        counts = (F.col("_failed") == 0) | ((F.col("_failed") == 1) & ~F.col(f"_p{i}"))
        pairs = F.transform(F.col(f"_v{i}"), lambda v: F.named_struct(
            F.lit("facet"), F.lit(facet.alias), F.lit("value"), v
        ))
        return F.filter(pairs, lambda p: counts)

    values = F.concat(*[counted_values(i, f) for i, f in enumerate(facets)])
    counted = rows.select(
        "query_id", _order().alias("_order"), F.inline(values),
    ).withColumn("n", F.lit(1))
    ranged = [f for f in facets if f.ranges]
    if ranged:
        zero = _zero_buckets(queries.select("query_id"), ranged)
        counted = counted.unionByName(zero, allowMissingColumns=True)
    return _top(_count(counted), facets)


def facet_requires(queries: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """Per query and selected facet: what it still waits for, and whether it is inert."""
    rows = queries.select("query_id", lower_filters(F.col("filters")).alias("_filters"))
    states = F.array(*[
        F.struct(F.lit(f.alias).alias("facet"), _chosen(f).isNotNull().alias("selected"), _missing(f).alias("missing"))
        for f in _enabled(facets)
    ])
    listed = rows.select("query_id", F.inline(states)).filter("selected")
    return listed.select(
        "query_id", "facet", F.array_join("missing", ", ").alias("waiting_for"),
        (F.size("missing") > 0).alias("is_inert"),
    )


def facet_min_active(queries: DataFrame, n: int) -> DataFrame:
    """Per query: how many selections are active and whether filtering applies."""
    active = F.size(F.map_keys(lower_filters(F.col("filters"))))
    return queries.select("query_id", active.alias("active"), (active >= max(n, 0)).alias("narrows"))


def facet_hide_empty(counts: DataFrame, queries: DataFrame, facets: Sequence[Facet]) -> DataFrame:
    """Labels and marks the counted values; zero ones go unless selected or the facet shows them."""
    by_alias = {f.alias.lower(): f for f in facets}

    def pick(col: Column, values: dict[str, object], kind: str) -> Column:
        parts = [F.lit(x) for pair in values.items() for x in pair]
        return F.try_element_at(F.create_map(*parts), col).cast(kind) if parts else F.lit(None).cast(kind)

    facet = F.lower("facet")
    bucket = F.concat_ws("\u0001", facet, F.lower("value"))
    labels = {
        f"{a}\u0001{r.alias.lower()}": r.label for a, f in by_alias.items() for r in f.ranges if r.label.strip()
    }
    chosen = queries.select("query_id", lower_filters(F.col("filters")).alias("_filters"))
    marked = counts.join(chosen, "query_id").select(
        "query_id", "facet",
        F.coalesce(pick(facet, {a: f.label for a, f in by_alias.items() if f.label.strip()}, "string"), F.col("facet")).alias("facet_label"),
        "value", F.coalesce(pick(bucket, labels, "string"), F.col("value")).alias("label"), "n",
        F.coalesce(F.array_contains(F.try_element_at(F.col("_filters"), facet), F.lower("value")), F.lit(False)).alias("is_selected"),
        F.coalesce(pick(facet, {a: f.hide_empty for a, f in by_alias.items()}, "boolean"), F.lit(True)).alias("_hide"),
    )
    return marked.filter((F.col("n") > 0) | F.col("is_selected") | ~F.col("_hide")).drop("_hide")
