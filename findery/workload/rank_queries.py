"""Registered queries: source rules, set operations, de-duplication and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import dedup as DD, filters as FL, rank as R, sets as ST
from findery.rules import BestBet, RuleSet, SortOption, SortRule
from findery.workload import tables as T
from findery.workload.registry import register

_TYPES = RuleSet(include_content_types=("src0", "SRC1", "src2", "src3"), exclude_types=("Src3",))


def _short(frame: DataFrame) -> DataFrame:
    return frame.select("query_id", "doc_key")


def _ranked(hits: DataFrame, *fields: str) -> DataFrame:
    """Ranked hits with what ranking reads and the fields that are sorted by: every row is written, texts need not be."""
    kept = F.map_filter("fields", lambda k, _: k.isin(list(fields))) if fields else F.create_map().cast("map<string,string>")
    narrow = hits.select("query_id", "doc_key", "index_rank", "is_best_bet", "score", "raw_score", kept.alias("fields"))
    return R.rank_hits(narrow)


def _keys(frame: DataFrame) -> DataFrame:
    return frame.select("index_name", "doc_key")


@register("type_gate", "SELECT index_name, doc_key FROM docs_both WHERE type_alias IN ('src0', 'src1', 'src2', 'src3')")
def type_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(FL.type_gate(T.docs_both(spark, sf_dir), _TYPES))


@register("type_exclude", "SELECT index_name, doc_key FROM docs_both WHERE type_alias <> 'src3'")
def type_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(FL.type_exclude(T.docs_both(spark, sf_dir), _TYPES))


@register("filter_subtree", "SELECT query_id, doc_key FROM hits_tree WHERE n_regionkey IN (0, 2) OR n_nationkey = 3")
def filter_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(FL.filter_subtree(T.hits_tree(spark, sf_dir), [1, 3, 103]))


@register(
    "filter_subtree_nodes",
    "SELECT query_id, doc_key FROM hits_tree WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def filter_subtree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots as a table: the nodes of customers with a finished order."""
    roots = T.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(
        (1000 + F.col("o_custkey")).alias("node_id")
    )
    return _short(FL.filter_subtree(T.hits_tree(spark, sf_dir), roots))


@register(
    "filter_excluded_nodes",
    "SELECT query_id, doc_key FROM hits_tree WHERE n_regionkey <> 1 AND n_nationkey <> 4 AND c_custkey <> 7",
)
def filter_excluded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(FL.filter_excluded_nodes(T.hits_tree(spark, sf_dir), [2, 104, 1007]))


@register("filter_excluded_nodes_only", "SELECT query_id, doc_key FROM hits_tree WHERE c_custkey <> 7")
def filter_excluded_nodes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(FL.filter_excluded_nodes(T.hits_tree(spark, sf_dir), [2, 104, 1007], descendants=False))


@register("filter_flags", "SELECT query_id, doc_key FROM hits_text WHERE f_hidefromsearch IS NULL")
def filter_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(FL.filter_flags(T.hits_text(spark, sf_dir), ["umbracoNaviHide", "hideFromSearch", " "]))


@register(
    "filter_flags_variant",
    """SELECT query_id, doc_key FROM hits_text WHERE NOT CASE WHEN f_hidefromsearch IS NOT NULL THEN FALSE
      ELSE coalesce(f_published = 'y', FALSE) END""",
)
def filter_flags_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain flag is falsy where present; elsewhere its culture variant decides."""
    fields = F.map_filter(F.create_map(
        F.lit("hide"), F.when(F.col("fields")["hidefromsearch"].isNotNull(), "0"),
        F.lit("hide_en"), F.col("fields")["__published"],
    ), lambda k, v: v.isNotNull())
    hits = T.hits_text(spark, sf_dir).withColumn("fields", fields)
    return _short(FL.filter_flags(hits, ["hide"]))


@register("filter_published", "SELECT query_id, doc_key FROM hits_text WHERE coalesce(f_published, 'y') = 'y'")
def filter_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(FL.filter_published(T.hits_text(spark, sf_dir)))


@register(
    "filter_protected",
    """SELECT query_id, doc_key FROM hits_tree WHERE n_nationkey % 7 <> 0 AND n_nationkey % 5 <> 1""",
)
def filter_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as nodes: protected, open, or looked up in vain."""
    key = F.col("n_nationkey")
    state = F.when(key % 7 == 0, F.lit(True)).when(key % 5 != 1, F.lit(False))
    nodes = T.table(spark, sf_dir, "nation").select((100 + key).alias("node_id"), state.alias("is_protected"))
    return _short(FL.filter_protected(T.hits_tree(spark, sf_dir), nodes))


@register("filter_min_score", "SELECT query_id, doc_key FROM hits_tree WHERE score >= 2500 OR c_custkey % 10 = 0")
def filter_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.hits_tree(spark, sf_dir).withColumn("is_best_bet", F.col("doc_key").endswith("0"))
    return _short(FL.filter_min_score(hits, 2500))


@register(
    "trim_fields",
    """SELECT query_id, doc_key, CASE WHEN f_published IS NULL THEN 'n_chars' ELSE '__published,n_chars' END AS kept
    FROM hits_text""",
)
def trim_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = FL.trim_fields(T.hits_text(spark, sf_dir), ["N_Chars", "__published"])
    kept = F.array_join(F.array_sort(F.map_keys("fields")), ",")
    return hits.select("query_id", "doc_key", kept.alias("kept"))


_MERGED = """SELECT query_id, index_name, doc_key FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id, node_id, index_type ORDER BY index_rank) AS n FROM hits_both) WHERE n = 1"""


@register("merge_indexes_first_wins", _MERGED)
def merge_indexes_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.merge_indexes_first_wins(T.hits_both(spark, sf_dir)).select("query_id", "index_name", "doc_key")


@register("dedup_identity", _MERGED)
def dedup_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DD.dedup_identity(T.hits_both(spark, sf_dir)).select("query_id", "index_name", "doc_key")


@register(
    "dedup_by_field",
    """SELECT query_id, doc_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(name)
      ORDER BY score DESC, doc_key) AS n FROM hits_parts) WHERE n = 1""",
)
def dedup_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(DD.dedup_by_field(T.hits_parts(spark, sf_dir), "nodeName"))


@register(
    "dedup_by_field_sparse",
    """SELECT query_id, doc_key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, f_published
      ORDER BY score DESC, doc_key) AS n FROM hits_text) WHERE n = 1 OR f_published IS NULL""",
)
def dedup_by_field_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(DD.dedup_by_field(T.hits_text(spark, sf_dir), "__Published"))


_BOOSTED = "score * CASE type_alias WHEN 'PROMO' THEN 2.0 WHEN 'ECONOMY' THEN 0.5 ELSE 1 END"


@register("boost_types", f"SELECT query_id, doc_key, round({_BOOSTED}, 6) AS score FROM hits_parts")
def boost_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.boost_types(T.hits_parts(spark, sf_dir), (("promo", 2.0), ("Economy", 0.5)))
    return hits.select("query_id", "doc_key", F.round("score", 6).alias("score"))


@register(
    "boost_recency",
    f"""SELECT query_id, doc_key, round(score * CASE WHEN age <= 0 THEN 1.5 ELSE 1 + 0.5 * pow(0.5, age / 90.0) END, 6) AS score
    FROM (SELECT *, (epoch_us(TIMESTAMP '{T.ORDERS_AS_OF}') - epoch_us(day)) / 1e6 / 86400.0 AS age FROM hits_orders)""",
)
def boost_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.boost_recency(T.hits_orders(spark, sf_dir), "orderdate", 90, 0.5, as_of=T.ORDERS_AS_OF)
    return hits.select("query_id", "doc_key", F.round("score", 6).alias("score"))


BETS = (
    BestBet(("red bolt",), ("0", "1", "2", "3", "4", "70", "200")), BestBet(("k1 k2",), ("5",)),
    BestBet(("screw  SMALL", "nothing"), ("65", "66", "131")),
)


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words searched per part query: those of the first name of its batch, with a synonym."""
    first = T.hits_parts(spark, sf_dir).groupBy("query_id").agg(F.min_by("name", "node_id").alias("term"))
    from findery.operators.terms import term_groups

    return term_groups(first, (), (("bolt", "screw"), ("ring", "screw")))


_TERM_SQL = """(SELECT query_id, list_concat(string_split(term, ' '), CASE WHEN term LIKE '%bolt' OR term LIKE '%ring'
  THEN ['screw'] ELSE [] END) AS words FROM (SELECT query_id, min_by(name, node_id) AS term FROM hits_parts GROUP BY ALL))"""
_PINNED = f"""SELECT h.*, (list_has_all(w.words, ['red', 'bolt']) AND h.doc_key IN ('0', '1', '2', '3', '4', '70', '200'))
  OR (list_has_all(w.words, ['screw', 'small']) AND h.doc_key IN ('65', '66', '131')) AS is_best_bet
FROM hits_parts h JOIN {_TERM_SQL} w ON w.query_id = h.query_id"""


@register(
    "pin_best_bets",
    f"""SELECT query_id, doc_key, is_best_bet, row_number() OVER (PARTITION BY query_id
      ORDER BY is_best_bet DESC, score DESC, doc_key) AS rank FROM ({_PINNED})""",
)
def pin_best_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.pin_best_bets(T.hits_parts(spark, sf_dir), _part_terms(spark, sf_dir), BETS)
    return _ranked(hits).select("query_id", "doc_key", "is_best_bet", "rank")


@register(
    "sort_multi",
    """SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY f_p_brand, n_size DESC,
      score DESC, doc_key) AS rank FROM (SELECT *, lower(f_p_brand) AS brand FROM hits_parts)""",
)
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(T.hits_parts(spark, sf_dir), "p_brand", "p_size")
    rules = [SortRule("p_brand"), SortRule("p_size", "descending"), SortRule("score", "descending")]
    return R.sort_multi(ranked, rules).select("query_id", "doc_key", "rank")


@register(
    "sort_multi_mixed",
    """SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY kind, d, num, txt, score DESC, doc_key) AS rank
    FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS kind,
        CASE WHEN o_orderkey % 4 = 1 THEN day END AS d, CASE WHEN o_orderkey % 4 = 2 THEN n_totalprice END AS num,
        CASE WHEN o_orderkey % 4 = 3 THEN lower(f_o_orderpriority) END AS txt FROM hits_orders)""",
)
def sort_multi_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field holding nothing, dates, numbers and text, its sort twin preferred."""
    form = F.col("node_id") % 4
    fields = F.col("fields")
    value = F.when(form == 1, fields["orderdate"]).when(form == 2, fields["o_totalprice"]).when(
        form == 3, fields["o_orderpriority"]
    )
    mixed = F.map_filter(
        F.create_map(F.lit("__sort_mixed"), value, F.lit("mixed"), F.when(value.isNotNull(), "zzz")),
        lambda k, v: v.isNotNull(),
    )
    ranked = _ranked(T.hits_orders(spark, sf_dir).withColumn("fields", mixed), "__sort_mixed", "mixed")
    return R.sort_multi(ranked, [SortRule("Mixed")]).select("query_id", "doc_key", "rank")


OPTIONS = (
    SortOption("newest", "Newest", "orderdate", "descending"), SortOption("price", "Price", "o_totalprice"),
    SortOption("best", "Relevance"), SortOption("hidden", "Hidden", "o_orderkey", enabled=False),
)


def _order_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.hits_orders(spark, sf_dir).select("query_id").distinct()
    sort = F.when(F.col("query_id") % 5 == 0, " Newest ").when(F.col("query_id") % 5 == 1, "PRICE").when(
        F.col("query_id") % 5 == 2, "best").when(F.col("query_id") % 5 == 3, "hidden")
    page = (F.col("query_id") % 4).cast("int")
    size = F.when(F.col("query_id") % 3 == 0, 7).when(F.col("query_id") % 3 == 1, 0)
    return T.query_defaults(ids.select(
        "query_id", F.when(F.col("query_id") % 4 == 0, "").otherwise("x").alias("term"), sort.alias("sort"),
        page.alias("page"), size.cast("int").alias("page_size"), (F.col("query_id") % 2 == 0).alias("allow_empty"),
    ))


_SORTED = """SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY
  CASE WHEN query_id % 5 = 0 THEN day END DESC NULLS LAST, CASE WHEN query_id % 5 = 1 THEN n_totalprice END,
  score DESC, doc_key) AS rank FROM hits_orders"""


@register("apply_sort_option", _SORTED)
def apply_sort_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(T.hits_orders(spark, sf_dir), "orderdate", "o_totalprice")
    return R.sort_by_option(ranked, _order_queries(spark, sf_dir), OPTIONS).select("query_id", "doc_key", "rank")


_PAGE = """SELECT query_id, greatest(query_id % 4, 1) AS page, CASE WHEN query_id % 3 = 0 THEN 7 WHEN query_id % 4 = 0 THEN {cap} ELSE 12 END AS size
  FROM (SELECT DISTINCT query_id FROM hits_orders)"""
# A query has its own size (7) if its id is divisible by 3, and browses if its id is divisible by 4.
_SLICE = """SELECT r.query_id, r.doc_key, r.rank FROM (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, doc_key) AS rank FROM hits_orders) r JOIN ({page}) p ON p.query_id = r.query_id
    WHERE r.rank > (p.page - 1) * p.size AND r.rank <= p.page * p.size"""


@register(
    "page_slice",
    _SLICE.format(page=_PAGE.format(cap=5)),
)
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(T.hits_orders(spark, sf_dir))
    rows, _ = R.page_slice(ranked, _order_queries(spark, sf_dir), 12, 5)
    return rows.select("query_id", "doc_key", "rank")


@register("page_slice_browse_none", _SLICE.format(page=_PAGE.format(cap=0)))
def page_slice_browse_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A browse cap of 0 shows nothing, except to queries with a size of their own."""
    ranked = _ranked(T.hits_orders(spark, sf_dir))
    return R.page_slice(ranked, _order_queries(spark, sf_dir), 12, 0)[0].select("query_id", "doc_key", "rank")


@register(
    "page_totals",
    f"""SELECT p.query_id, n AS total, p.page, p.size AS page_size, CAST(ceil(n / p.size) AS BIGINT) AS total_pages,
      p.page < ceil(n / p.size) AS has_more
    FROM ({_PAGE.format(cap=5)}) p JOIN (SELECT query_id, count(*) AS n FROM hits_orders GROUP BY ALL) c ON c.query_id = p.query_id""",
)
def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(T.hits_orders(spark, sf_dir))
    return R.page_slice(ranked, _order_queries(spark, sf_dir), 12, 5)[1]


@register(
    "curated_browse",
    """SELECT query_id, doc_key, rank FROM (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, doc_key) AS rank FROM hits_orders WHERE query_id % 6 <> 0)
    UNION ALL SELECT query_id, doc_key, rank FROM (SELECT DISTINCT query_id FROM hits_orders WHERE query_id % 6 = 0)
      CROSS JOIN (VALUES ('12', 1), ('5', 2), ('900', 3)) AS p(doc_key, rank)""",
)
def curated_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(T.hits_orders(spark, sf_dir))
    picks = ["12", "missing", "5", "900"]
    # The query that holds a third of all hits is no browse query, so its hits are ranked too.
    term = F.when(F.col("query_id") % 6 == 0, "").otherwise("x")
    queries = _order_queries(spark, sf_dir).withColumn("term", term)
    shown = R.curated_browse(ranked, queries, T.docs_orders(spark, sf_dir), picks)
    return shown.select("query_id", "doc_key", "rank")


@register(
    "apply_rerank",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_best_bet DESC, score DESC, doc_key) AS rank
      FROM ({_PINNED})), page AS (SELECT *, CASE WHEN NOT is_best_bet THEN row_number() OVER (PARTITION BY query_id, is_best_bet
        ORDER BY rank) END AS n FROM r WHERE rank <= 30),
    ids AS (SELECT * FROM (VALUES (0, 3, 1), (0, 1, 2), (0, 2, 3), (1, 5, 1), (1, 4, 2), (2, 2, 1), (2, 7, 2), (6, 20, 1),
      (6, 19, 2)) AS v(kind, id, place))
    SELECT p.query_id, p.doc_key, row_number() OVER (PARTITION BY p.query_id ORDER BY p.is_best_bet DESC,
      i.place NULLS LAST, p.rank) AS rank
    FROM page p LEFT JOIN ids i ON i.kind = p.query_id % 7 AND i.id = p.n""",
)
def apply_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.pin_best_bets(T.hits_parts(spark, sf_dir), _part_terms(spark, sf_dir), BETS)
    page = _ranked(hits).filter("rank <= 30")
    ranked = R.apply_rerank(page, T.rerank_replies(spark, sf_dir))
    return ranked.select("query_id", "doc_key", "rank")


@register("group_counts", "SELECT query_id, lower(type_alias) AS type, count(*) AS hits FROM hits_tree GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_counts(T.hits_tree(spark, sf_dir))
