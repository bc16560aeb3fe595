"""Registered queries: sources, sinks and scalar projections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.functions import dates as D, fields as X, paths as P, text as TX
from findery.session import shared_folder
from findery.sources import indexes as I, logs as L, pages as PG
from findery.workload import tables as T
from findery.workload.describe_queries import _shorten_sql
from findery.workload.extract_queries import encoded_sql
from findery.workload.registry import register
from findery.workload.stream_queries import _LOGGED


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/source-{uuid.uuid4().hex}"


@register(
    "scan_indexes",
    """SELECT 'parts' AS index_name, 0 AS index_rank, doc_key, name, type_alias FROM docs_parts
    UNION ALL SELECT 'Customers', 1, doc_key, name, type_alias FROM docs_tree
    UNION ALL SELECT 'orders', 2, doc_key, name, type_alias FROM docs_orders""",
)
def scan_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three stored indexes read back: the preferred one first, the rest by name."""
    base = _folder(spark)
    frames = {"orders": T.docs_orders, "Customers": T.docs_tree, "parts": T.docs_parts}
    for name, build in frames.items():
        build(spark, sf_dir).drop("index_name", "index_rank").write.parquet(f"{base}/{name}")
    specs = [I.IndexSpec(n, f"{base}/{n}") for n in frames]
    docs = I.scan_indexes(spark, specs, preferred="Parts")
    return docs.select("index_name", "index_rank", "doc_key", "name", "type_alias")


@register(
    "index_stats",
    """SELECT index_name, count(*) AS document_count, CASE index_name WHEN 'parts' THEN 4 ELSE 4 + count(DISTINCT culture) END AS field_count, TRUE AS is_healthy
    FROM (SELECT index_name, culture FROM docs_both UNION ALL SELECT index_name, NULL FROM docs_parts) GROUP BY index_name""",
)
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.index_stats(T.docs_both(spark, sf_dir).unionByName(T.docs_parts(spark, sf_dir)))


@register(
    "discover_fields",
    """SELECT field, type, is_system, is_searchable, is_sortable, looks_structured, is_extracted, sample FROM (
      SELECT 'p_brand' AS field, 'fulltext' AS type, FALSE AS is_system, TRUE AS is_searchable, TRUE AS is_sortable, FALSE AS looks_structured,
        FALSE AS is_extracted, min_by(f_p_brand, node_id) AS sample FROM docs_parts
      UNION ALL SELECT 'p_size', 'Int', FALSE, FALSE, TRUE, FALSE, FALSE, min_by(CAST(n_size AS VARCHAR), node_id) FROM docs_parts
      UNION ALL SELECT 'extractedcontent_en', 'fulltext', FALSE, TRUE, FALSE, TRUE, TRUE, min_by('{"a": "' || name || '"}', node_id) FROM docs_parts WHERE type_alias = 'PROMO'
      UNION ALL SELECT 'sortorder', 'fulltext', FALSE, FALSE, FALSE, FALSE, FALSE, min_by(doc_key, node_id) FROM docs_parts
      UNION ALL SELECT '__nodename', 'fulltext', TRUE, TRUE, FALSE, FALSE, FALSE, min_by(name, node_id) FROM docs_parts
      UNION ALL SELECT '__icon', 'fulltext', TRUE, FALSE, FALSE, FALSE, FALSE, min_by(name, node_id) FROM docs_parts)""",
)
def discover_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    docs = T.docs_parts(spark, sf_dir).withColumn("fields", F.map_filter(F.create_map(
        F.lit("p_brand"), c("fields")["p_brand"], F.lit("__sort_p_brand"), F.lower(c("fields")["p_brand"]),
        F.lit("p_size"), c("fields")["p_size"], F.lit("sortorder"), c("doc_key"), F.lit("__nodename"), c("name"),
        F.lit("__icon"), c("name"), F.lit("__raw_x"), c("name"),
        F.lit("extractedcontent_en"), F.when(c("type_alias") == "PROMO", F.concat(F.lit('{"a": "'), c("name"), F.lit('"}'))),
    ), lambda k, v: v.isNotNull()))
    return I.discover_fields(docs, {"P_Size": "Int"}).drop("index_name")


@register("list_types", "SELECT DISTINCT index_type, type_alias FROM docs_tree")
def list_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.list_types(T.docs_tree(spark, sf_dir))


@register("list_cultures", "SELECT DISTINCT culture, culture = 'fr' AS is_default FROM docs_text")
def list_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.list_cultures(T.docs_text(spark, sf_dir), "FR")


@register(
    "find_search_pages",
    """SELECT DISTINCT lower(CASE WHEN f_url IN ('', '/') THEN f_url ELSE regexp_replace(f_url, '/+$', '') END) AS path
    FROM docs_pages WHERE type_alias = 'Search-Results' AND f_url <> '' AND NOT starts_with(f_url, '//')""",
)
def find_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = T.docs_pages(spark, sf_dir).select(F.col("fields")["url"].alias("path"), "type_alias")
    return PG.find_search_pages(pages)


@register(
    "parse_search_urls",
    """SELECT event_id AS request_id, 'red k' || json_extract_string(props, '$.k') AS term, greatest(1, event_id % 4) AS page,
      'newest' AS sort, 'type=' || event_type || '|view' AS filters FROM events""",
)
def parse_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = PG.parse_search_urls(T.request_urls(spark, sf_dir))
    filters = F.array_join(F.transform(
        F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))
    ), ";")
    return rows.select("request_id", "term", F.col("page").cast("bigint").alias("page"), "sort", filters.alias("filters"))


@register("write_search_log", _LOGGED)
def write_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    L.write_search_log(T.raw_searches(spark, sf_dir), path)
    return spark.read.parquet(path).select("query_key", "term", "normalized_term", "result_count", "culture")


@register("write_search_log_zero_only", f"SELECT * FROM ({_LOGGED}) WHERE result_count = 0 AND length(term) >= 10")
def write_search_log_zero_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = L.LogSettings(minimum_term_length=10, zero_results_only=True)
    rows = L.searches_to_log(T.raw_searches(spark, sf_dir), settings)
    return rows.select("query_key", "term", "normalized_term", "result_count", "culture")


@register("write_click_log", "SELECT query_key, node_key, substring(repeat(node_name, 40), 1, 255) AS node_name, position FROM click_log WHERE query_key % 3 <> 0")
def write_click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    clicks = T.click_log(spark, sf_dir).withColumns({
        "query_key": F.when(F.col("query_key") % 3 != 0, F.col("query_key")), "node_name": F.repeat("node_name", F.lit(40)),
    })
    L.write_click_log(clicks, path)
    return spark.read.parquet(path).select("query_key", "node_key", "node_name", "position")


_STAMP = "yyyy-MM-dd HH:mm:ss"


@register("parse_dates", "SELECT doc_key, strftime(day, '%Y-%m-%d %H:%M:%S') AS date FROM docs_orders")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs_orders(spark, sf_dir)
    return docs.select("doc_key", F.date_format(D.parse_date(F.col("fields")["orderdate"]), _STAMP).alias("date"))


_FORMS = ("yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "d MMMM yyyy HH:mm:ss", "MMM d, yyyy HH:mm:ss")


@register(
    "parse_dates_written",
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3652 DAY + CASE WHEN o_orderkey % 4 = 0 THEN INTERVAL 8 HOUR ELSE INTERVAL 10 HOUR END, "
    "'%Y-%m-%d %H:%M:%S') AS date FROM orders",
)
def parse_dates_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written forms of ten o'clock; the first with an offset of two hours, the third with a weekday and GMT."""
    orders = T.table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '3652 10' DAY TO HOUR")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.date_format(at, _FORMS[0]), F.lit("+02:00"))).when(kind == 1, F.date_format(at, _FORMS[1]))
    text = text.when(kind == 2, F.concat(F.date_format(at, "EEE"), F.lit(", "), F.date_format(at, _FORMS[2]), F.lit(" GMT"))).otherwise(F.date_format(at, _FORMS[3]))
    return orders.select("o_orderkey", F.date_format(D.parse_date(text), _STAMP).alias("date"))


@register(
    "parse_numbers_written",
    """SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_size * 1000.0 WHEN 1 THEN -p_size::DOUBLE END AS number FROM part""",
)
def parse_numbers_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thousands separators, parentheses, and codes that only look like numbers."""
    kind, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    raw = F.when(kind == 0, F.concat(size, F.lit(",000.0"))).when(kind == 1, F.concat(F.lit("("), size, F.lit(")"))).when(
        kind == 2, F.concat(size, F.lit("d"))).otherwise(F.concat(size, F.lit("f")))
    return T.table(spark, sf_dir, "part").select("p_partkey", D.parse_number(raw).alias("number"))


@register(
    "parse_numbers",
    "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN p_retailprice WHEN 1 THEN CAST(p_size AS DOUBLE) END AS number FROM part",
)
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"), F.lit(" "))).when(
        kind == 1, F.col("p_size").cast("string")).when(kind == 2, "NaN").otherwise(F.col("p_name"))
    return T.table(spark, sf_dir, "part").select("p_partkey", D.parse_number(raw).alias("number"))


@register("truthy", "SELECT doc_key, coalesce(f_published = 'y', FALSE) AS published, coalesce(f_hidefromsearch = '1', FALSE) AS hidden FROM docs_text")
def truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs_text(spark, sf_dir)
    shout = F.when(F.col("fields")["hidefromsearch"] == "1", "TRUE").otherwise("no")
    return docs.select("doc_key", X.truthy(X.stored("__Published")).alias("published"), X.truthy(shout).alias("hidden"))


@register(
    "field_value",
    """SELECT doc_key, f_p_brand AS brand, name AS name_value, type_alias AS type_value, doc_key AS key_value,
      CAST(node_id AS VARCHAR) AS id_value, array_to_string(path, ',') AS path_value FROM docs_parts""",
)
def field_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"brand": "P_BRAND", "name_value": "nodeName", "type_value": "contentTypeAlias", "key_value": "__Key", "id_value": "id", "path_value": "__Path"}
    return T.docs_parts(spark, sf_dir).select("doc_key", *[X.sortable_value(f).alias(a) for a, f in names.items()])


@register("shorten_text", f"SELECT conv_id, turn, {_shorten_sql('text', 60)} AS short FROM conversations")
def shorten_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", TX.shorten(F.col("text"), 60).alias("short"))


_ENCODED = encoded_sql("html")


@register("html_encode", f"SELECT page_id, {_ENCODED} AS html FROM pages")
def html_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "pages").select("page_id", TX.html_encode(F.col("html")).alias("html"))


@register(
    "decode_entities",
    """SELECT page_id, replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS html,
      '&lt;é€' || page_id AS made FROM pages""",
)
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("&amp;lt;&eacute;&#x20AC;"), F.col("page_id").cast("string"))
    pages = T.table(spark, sf_dir, "pages")
    return pages.select("page_id", TX.decode_entities(F.col("html")).alias("html"), TX.decode_entities(made).alias("made"))


@register("truncate_columns", "SELECT doc_id, substring(text, 1, 500) AS term, substring(source, 1, 3) AS source FROM documents")
def truncate_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("term"), "source")
    return L.truncate_columns(docs, {"term": 500, "source": 3, "absent": 9})


@register(
    "normalize_paths",
    """SELECT page_id, CASE WHEN p = '' THEN '' ELSE lower(CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END) END AS path, '' AS away
    FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '') AS p FROM pages)""",
)
def normalize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = F.regexp_replace("url", "^https?://[^/]*", "")
    away = F.regexp_replace("url", "^https?:", "")
    return T.table(spark, sf_dir, "pages").select(
        "page_id", P.normalize_path(inside).alias("path"), P.normalize_path(away).alias("away")
    )
