"""Boosts, best bets, order, pages and re-ranking of hits.

A query may have any number of hits. A page takes its first rows by bounded heaps over pieces of a query's
hits, merged afterwards, so no task meets all of them. ``rank_hits``, ``sort_multi`` and ``sort_by_option`` number
every hit; they place hits by ranges of the order, so a query of any size is many tasks' work too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.functions import dates as D, fields as X
from findery.functions.text import let
from findery.operators.dedup import rank_order
from findery.rules import BestBet, SortOption, SortRule, lookup
from findery.session import store

MIN_RERANKED = 3
RELEVANCE = "score"
DEFAULT_PAGE_SIZE = 10


def _per_query(*order: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*order)


def numbered(rows: DataFrame, order: Sequence[Column], out: str) -> DataFrame:
    """All rows of each query, numbered in ``out`` by ``order``.

    Rows are written once, as ranges are found by a look at all of them, and once more in ranges of query and order, so that
    these stand fast. A range numbers its own rows; the one query that goes on from earlier ranges adds its rows there.
    """
    ranges = store(rows).repartitionByRange("query_id", *order).withColumn("_range", F.spark_partition_id())
    placed = store(ranges)
    counts = placed.groupBy("query_id", "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(_per_query(F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    # A row a range at most, however many queries there are.
    going_on = counts.withColumn("_before", earlier).filter("_before > 0").select(
        "_range", F.col("query_id").alias("_going_on"), "_before")
    local = Window.partitionBy("query_id", "_range").orderBy(*order)
    found = placed.withColumn(out, F.row_number().over(local)).join(F.broadcast(going_on), "_range", "left")
    before = F.when(F.col("query_id").eqNullSafe(F.col("_going_on")), F.col("_before"))
    return found.withColumn(out, (F.col(out) + F.coalesce(before, F.lit(0))).cast("int")).drop("_range", "_going_on", "_before")


def _numbered_by_keys(rows: DataFrame, keys: Sequence[tuple[Column, str]], out: str) -> DataFrame:
    """Rows numbered anew: best bets, then each key in its direction, then the number they had."""
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.withColumns({n: key for n, (key, _) in zip(names, keys, strict=True)})
    order = [_directed(F.col(n), direction) for n, (_, direction) in zip(names, keys, strict=True)]
    return numbered(keyed, [F.desc("is_best_bet"), *order, F.asc(out)], "_again").drop(out, *names).withColumnRenamed("_again", out)


def boost_types(hits: DataFrame, type_boosts: Sequence[tuple[str, float]]) -> DataFrame:
    """``score = raw_score × boost`` of the row's type, 1 without one."""
    boosts = {alias: float(boost) for alias, boost in type_boosts}
    boost = F.coalesce(lookup(F.col("type_alias"), boosts, "double"), F.lit(1.0))
    return hits.withColumn("score", F.col("raw_score") * boost)


def recency_factor(field: str, half_life: int, weight: float, as_of: str) -> Column:
    date = D.parse_date(X.stored(field))
    now = D.as_of_literal(as_of)
    # Microseconds of a zone-less difference, as days.
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / 1e6
    age = seconds / 86400.0
    decay = F.pow(F.lit(0.5), age / F.lit(float(max(1, half_life))))
    return (
        F.when(date.isNull(), F.lit(1.0)).when(age <= 0, F.lit(1.0 + weight))
        .otherwise(1.0 + weight * decay)
    )


def boost_recency(
    hits: DataFrame, field: str, half_life: int = 90, weight: float = 0.5, *, as_of: str
) -> DataFrame:
    """Newer rows gain up to ``weight``, halved every ``half_life`` days; no date, no change."""
    return hits.withColumn("score", F.col("score") * recency_factor(field, half_life, weight, as_of))


def fired_keys(query_terms: DataFrame, best_bets: Sequence[BestBet]) -> DataFrame:
    """(query_id, keys) of the bets that fire: all words of one of their terms were searched.

    A query's words meet the bets inside its row, and only queries with a firing bet come out.
    """
    words = query_terms.groupBy("query_id").agg(F.collect_set(F.lower("variant")).alias("words"))
    bets = []
    for bet in best_bets:
        for term in bet.terms:
            parts = [w.lower() for w in term.split(" ") if w]
            if parts and bet.node_keys:
                bets.append(F.struct(
                    F.array(*[F.lit(w) for w in parts]).alias("words"),
                    F.array(*[F.lit(k.lower()) for k in bet.node_keys]).alias("keys"),
                ))
    if not bets:
        return words.select("query_id", F.array().cast("array<string>").alias("keys")).limit(0)
    fired = F.filter(
        F.array(*bets), lambda b: F.size(F.array_except(b["words"], F.col("words"))) == 0
    )
    keys = F.array_distinct(F.flatten(F.transform(fired, lambda b: b["keys"])))
    return words.select("query_id", keys.alias("keys")).filter(F.size("keys") > 0)


def pin_best_bets(hits: DataFrame, query_terms: DataFrame, best_bets: Sequence[BestBet]) -> DataFrame:
    """Flags the chosen rows of the bets that fire; the flag sorts before the score."""
    if not best_bets:
        return hits
    fired = fired_keys(query_terms, best_bets)
    flagged = hits.join(fired, "query_id", "left").withColumn(
        "is_best_bet", F.coalesce(F.array_contains("keys", F.lower("doc_key")), F.lit(False))
    )
    return flagged.drop("keys")


def rank_hits(hits: DataFrame) -> DataFrame:
    """``rank``: best bets, then score; ties keep the order the indexes gave."""
    return numbered(hits, rank_order(), "rank")


def sort_key(field: str | Column) -> Column:
    """A comparable key: nothing, then dates, then numbers, then text ignoring case."""
    raw = X.sortable_value(field) if isinstance(field, str) else field

    def key(value: Column) -> Column:
        return let(D.parse_date(value), lambda date: let(D.parse_number(value), lambda number: F.named_struct(
            F.lit("kind"),
            F.when(value.isNull(), 0).when(date.isNotNull(), 1).when(number.isNotNull(), 2).otherwise(3),
            F.lit("date"), date, F.lit("number"), F.when(date.isNull(), number),
            F.lit("text"), F.when(date.isNull() & number.isNull(), F.lower(value)),
        )))

    return let(F.nullif(raw, F.lit("")), key)


def _score_key() -> Column:
    return F.struct(
        F.lit(2).alias("kind"), F.lit(None).cast(D.NTZ).alias("date"), F.col("score").alias("number"),
        F.lit(None).cast("string").alias("text"),
    )


def sort_column(field: str) -> str:
    """The column in which an index keeps a field's parsed sort key."""
    return f"sort:{field.strip().lower()}"


def _key_of(field: str, columns: Sequence[str] = ()) -> Column:
    if field.lower() == RELEVANCE:
        return _score_key()
    kept = sort_column(field)
    return F.col("`" + kept.replace("`", "``") + "`") if kept in columns else sort_key(field)


def _directed(key: Column, direction: str) -> Column:
    return key.asc() if direction == "ascending" else key.desc()


def _rule_keys(hits: DataFrame, sort_rules: Sequence[SortRule]) -> list[tuple[Column, str]]:
    return [(_key_of(r.field, hits.columns), r.direction) for r in sort_rules if r.field.strip()]


def sort_order(hits: DataFrame, sort_rules: Sequence[SortRule], last: Sequence[Column]) -> list[Column]:
    """Best bets, then each rule in turn, then ``last``."""
    return [F.desc("is_best_bet"), *[_directed(*k) for k in _rule_keys(hits, sort_rules)], *last]


def sort_multi(hits: DataFrame, sort_rules: Sequence[SortRule]) -> DataFrame:
    """Best bets, then each rule in turn; ties keep the previous rank."""
    keys = _rule_keys(hits, sort_rules)
    return _numbered_by_keys(hits, keys, "rank") if keys else hits


def apply_sort_option(queries: DataFrame, sort_options: Sequence[SortOption]) -> DataFrame:
    """Adds the alias, field and direction of the requested sort.

    All null means the profile's own order; an option without a field is plain relevance.
    """
    enabled = {
        o.alias: o for o in reversed(sort_options) if o.enabled and o.alias.strip()
    }
    asked = F.trim(F.coalesce("sort", F.lit("")))
    pick = lambda values: lookup(asked, values, "string")
    return queries.withColumns({
        "sort_alias": pick({a: o.alias for a, o in enabled.items()}),
        "sort_field": pick({a: o.field.strip() for a, o in enabled.items() if o.field.strip()}),
        "sort_direction": pick({a: o.direction for a, o in enabled.items() if o.field.strip()}),
    })


def with_sort_alias(hits: DataFrame, queries: DataFrame, sort_options: Sequence[SortOption]) -> DataFrame:
    picked = apply_sort_option(queries, sort_options).select("query_id", "sort_alias")
    return hits.join(picked, "query_id", "left")


def _option_keys(hits: DataFrame, sort_options: Sequence[SortOption]) -> list[tuple[Column, str]]:
    """Every enabled option's key is a column of the row; a query's alias picks the one that counts."""
    options = {o.alias.lower(): o for o in reversed(sort_options) if o.enabled and o.alias.strip() and o.field.strip()}
    alias = F.lower("sort_alias")
    return [(F.when(alias == n, _key_of(o.field, hits.columns)), o.direction) for n, o in options.items()]


def option_order(hits: DataFrame, sort_options: Sequence[SortOption], last: Sequence[Column]) -> list[Column]:
    """The order each row's ``sort_alias`` asks for, best bets first, then ``last``."""
    return [F.desc("is_best_bet"), *[_directed(*k) for k in _option_keys(hits, sort_options)], *last]


def sort_by_option(hits: DataFrame, queries: DataFrame, sort_options: Sequence[SortOption]) -> DataFrame:
    """Each query's rows in the order its sort option asks for, best bets first."""
    ranked = with_sort_alias(hits, queries, sort_options)
    return _numbered_by_keys(ranked, _option_keys(ranked, sort_options), "rank").drop("sort_alias")


def is_browse() -> Column:
    """Whether a query asks for a listing without a term."""
    return F.col("allow_empty") & (F.trim(F.coalesce("term", F.lit(""))) == "")


def first_rows(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str, piece_of: Sequence[str] = ("doc_key",)
) -> DataFrame:
    """The first ``n`` rows of each group, numbered in ``out``.

    A group is dealt into pieces by hash; each piece keeps its first ``n`` rows (Spark limits them before the shuffle
    too), and only those meet. A group of any size thus brings at most pieces x n rows into one task. There are as many pieces
    as shuffle partitions, which grow with the data.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_piece", F.pmod(F.xxhash64(*piece_of), F.lit(pieces)))
    local = Window.partitionBy(*keys, "_piece").orderBy(*order)
    heaps = dealt.withColumn("_n", F.row_number().over(local)).filter(F.col("_n") <= n).drop("_n", "_piece")
    merged = Window.partitionBy(*keys).orderBy(*order)
    return heaps.withColumn(out, F.row_number().over(merged)).filter(F.col(out) <= n)


def wanted_pages(queries: DataFrame, page_size: int, browse_size: int) -> DataFrame:
    """(query_id, _page, _size): the page each query asks for and the rows it holds."""
    own = F.when(F.col("page_size") > 0, F.col("page_size"))
    profile = page_size if page_size > 0 else DEFAULT_PAGE_SIZE
    size = F.coalesce(own, F.when(is_browse(), min(profile, max(browse_size, 0))).otherwise(profile))
    return queries.select(
        "query_id", F.greatest(F.coalesce("page", F.lit(1)), F.lit(1)).alias("_page"), size.alias("_size")
    )


def page_slice(
    hits: DataFrame, queries: DataFrame, page_size: int = DEFAULT_PAGE_SIZE, browse_size: int = DEFAULT_PAGE_SIZE,
    order: Sequence[Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows of each query's page with their ``rank``, totals per query).

    Hits that carry a rank are cut by it; others are ordered by ``order``, or best bets and score. The
    query's own size wins over the profile's. An empty search without its own size shows at most
    ``browse_size`` rows, none if that is 0; its totals still count all.
    """
    wanted = wanted_pages(queries, page_size, browse_size)
    ranked = hits
    if "rank" not in hits.columns:
        # One number about the query table: how far down the farthest page reaches.
        last = wanted.agg(F.max(F.col("_page").cast("long") * F.col("_size"))).first()[0]
        ranked = first_rows(hits, ["query_id"], order or rank_order(), min(int(last or 0), 2**31 - 1), "rank")
    rows = ranked.join(wanted, "query_id").filter(
        (F.col("rank") > (F.col("_page") - 1) * F.col("_size"))
        & (F.col("rank") <= F.col("_page") * F.col("_size"))
    )
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    totals = wanted.join(counts, "query_id", "left").select(
        "query_id", F.coalesce("total", F.lit(0)).alias("total"), F.col("_page").alias("page"),
        F.col("_size").alias("page_size"),
    )
    totals = totals.withColumn("total_pages", F.coalesce(F.ceil(F.try_divide("total", "page_size")), F.lit(0)))
    return rows.drop("_page", "_size"), totals.withColumn("has_more", F.col("page") < F.col("total_pages"))


def curated_browse(
    hits: DataFrame, queries: DataFrame, docs: DataFrame, picks: Sequence[str]
) -> DataFrame:
    """Empty searches show the picked documents in order, where at least one of them exists."""
    keys = [k.strip().lower() for k in picks if k.strip()]
    if not keys:
        return hits
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.lower("doc_key"))
    chosen = docs.filter(F.lower("doc_key").isin(keys)).withColumn("rank", place.cast("int"))
    # The same document may sit in several indexes; a pick is shown once.
    first = Window.partitionBy("rank").orderBy("index_rank", "index_name")
    chosen = chosen.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    browse = queries.filter(is_browse()).select("query_id")
    # One picked list per browse query, held as an array of at most len(picks) rows.
    listed = chosen.select(F.collect_list(F.struct(*[c for c in hits.columns if c in chosen.columns])).alias("rows"))
    replaced = browse.withColumn("rows", listed.scalar()).select("query_id", F.inline("rows"))
    for column in hits.columns:
        if column not in replaced.columns:
            empty = {"score": F.lit(0.0), "raw_score": F.lit(0.0), "is_best_bet": F.lit(False)}
            kind = hits.schema[column].dataType
            replaced = replaced.withColumn(column, empty.get(column, F.lit(None)).cast(kind))
    ranked = replaced.withColumn("rank", F.row_number().over(_per_query(F.asc("rank"))))
    kept = hits.join(replaced.select("query_id").distinct(), "query_id", "left_anti")
    return kept.unionByName(ranked.select(*kept.columns))


def reply_object(reply: Column) -> Column:
    """The reply from its first ``{`` on, trailing commas removed; parsers stop at its end."""
    start = F.instr(reply, "{")
    cut = F.when(start > 0, F.substr(reply, start))
    return F.regexp_replace(cut, r",\s*([}\]])", "$1")


def apply_rerank(page_hits: DataFrame, replies: DataFrame, depth: int = 20) -> DataFrame:
    """Pinned rows, then the rows a reply lists by number, then the rest in their old order.

    Numbers count the page's unpinned rows from 1, up to ``depth``. Fewer than three
    of those, or no usable number, leaves a query as it was.
    """
    numbered = page_hits.withColumn(
        "_n", F.when(~F.col("is_best_bet"), F.row_number().over(
            Window.partitionBy("query_id", "is_best_bet").orderBy("rank")
        ))
    )
    counts = page_hits.groupBy("query_id").agg(
        F.sum((~F.col("is_best_bet")).cast("int")).alias("_orderable")
    )
    order = F.from_json(reply_object(F.col("reply")), "order array<string>")["order"]
    ids = F.filter(
        F.transform(order, lambda v: F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), v.try_cast("int"))),
        lambda i: i.isNotNull() & (i >= 1),
    )
    listed = replies.select("query_id", F.array_distinct(ids).alias("_ids"))
    joined = numbered.join(counts, "query_id").join(listed, "query_id", "left")
    limit = F.least(F.col("_orderable"), F.lit(depth))
    usable = F.when(
        F.col("_orderable") >= MIN_RERANKED, F.filter("_ids", lambda i: i <= limit)
    )
    place = F.nullif(F.array_position(usable, F.col("_n")), F.lit(0))
    order_by = [F.desc("is_best_bet"), F.asc_nulls_last("_place"), F.asc("rank")]
    ranked = joined.withColumn("_place", F.when(F.col("_n").isNotNull(), place))
    return ranked.withColumn("rank", F.row_number().over(_per_query(*order_by))).drop(
        "_n", "_orderable", "_ids", "_place"
    )


def group_counts(hits: DataFrame) -> DataFrame:
    """Survivors per content type, ignoring case."""
    return hits.groupBy("query_id", F.lower("type_alias").alias("type")).agg(
        F.count(F.lit(1)).alias("hits")
    )
