"""Registered queries: facets."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.operators import facets as FC
from findery.rules import Facet, FacetRange
from findery.workload import tables as T
from findery.workload.registry import register

AS_OF = T.ORDERS_AS_OF

PRICE = Facet("price", "p_retailprice", "Price", "numeric", (
    FacetRange("p-low", "Cheap", "", "925"), FacetRange("p-mid", "Middle", "925", "975"),
    FacetRange("p-high", "", "975", ""),
), hide_empty=False)
LABELLED = Facet("band", "p_retailprice", "", "numeric", (
    FacetRange("a", "under 925"), FacetRange("b", "925-950"), FacetRange("c", "950 to 975"), FacetRange("d", "over 975"),
))
BRAND = Facet("Brand", "p_brand", "Brand", requires=())
TAGS = Facet("tags", max_values=5)
SIZE = Facet("size", "p_size", "Size", requires=("brand",), max_values=0)
YEARS = Facet("year", "orderdate", "Year", "dateRange", tuple(FacetRange(f"y{y}", str(y)) for y in range(2005, 2012)) + (
    FacetRange("recent", "", "now-30d", ""), FacetRange("lately", "last year"), FacetRange("first", "", "", "20060101"),
))
REGION = Facet("region", "__Path", "Region", "field", (
    FacetRange("africa", "Africa", "1"), FacetRange("asia", "Asia", "umb://document/{0}"), FacetRange("1004", "Node"),
    FacetRange("none", "", "99999"),
))


def _counts(frame: DataFrame) -> DataFrame:
    return frame.select("query_id", "value", F.col("n").cast("bigint").alias("n"))


@register(
    "facet_field",
    """SELECT query_id, value, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, lower(value)) AS k
      FROM (SELECT query_id, value, count(*) AS n FROM (SELECT query_id, unnest(string_split(f_tags, ',')) AS value FROM hits_parts)
      GROUP BY ALL)) WHERE k <= 5""",
)
def facet_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(FC.facet_field(T.hits_parts(spark, sf_dir), TAGS))


def _bucket_sql(frame: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT query_id, '{alias}' AS value, count(*) FILTER (WHERE {test}) AS n FROM {frame} GROUP BY query_id"
        for alias, test in tests.items()
    )


_PRICE_TESTS = {"p-low": "n_price < 925", "p-mid": "n_price >= 925 AND n_price < 975", "p-high": "n_price >= 975"}


@register("facet_numeric_range", _bucket_sql("hits_parts", _PRICE_TESTS))
def facet_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(FC.facet_numeric_range(T.hits_parts(spark, sf_dir), PRICE))


@register("facet_numeric_inferred", _bucket_sql("hits_parts", {
    "a": "n_price < 925", "b": "n_price >= 925 AND n_price < 950", "c": "n_price >= 950 AND n_price < 975",
    "d": "n_price >= 975"}))
def facet_numeric_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(FC.facet_numeric_range(T.hits_parts(spark, sf_dir), LABELLED))


_YEAR_TESTS = {
    **{f"y{y}": f"year(day) = {y}" for y in range(2005, 2012)},
    "recent": f"day >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY",
    "lately": f"day >= TIMESTAMP '{AS_OF}' - INTERVAL 1 YEAR AND day < TIMESTAMP '{AS_OF}'",
    "first": "day < TIMESTAMP '2006-01-01'",
}


@register("facet_date_range", _bucket_sql("hits_orders", _YEAR_TESTS))
def facet_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(FC.facet_date_range(T.hits_orders(spark, sf_dir), YEARS, AS_OF))


def _node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region nodes by a GUID made from the region's name."""
    guid = F.regexp_replace(F.md5("r_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return T.table(spark, sf_dir, "region").select(guid.alias("node_key"), (1 + F.col("r_regionkey")).alias("node_id"))


def _guid(name: str) -> str:
    return str(uuid.UUID(hashlib.md5(name.encode()).hexdigest()))


def _region_facet() -> Facet:
    ranges = tuple(
        FacetRange(r.alias, r.label, r.from_bound.format(_guid("ASIA"))) for r in REGION.ranges
    )
    return Facet(REGION.alias, REGION.field, REGION.label, REGION.kind, ranges)


@register("facet_subtree", _bucket_sql("hits_tree", {
    "africa": "n_regionkey = 0 OR doc_key = '1'", "asia": "n_regionkey = 2", "1004": "c_custkey = 4 OR doc_key = '1004'", "none": "c_custkey = 99999 OR node_id = 99999"}))
def facet_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(FC.facet_subtree(T.hits_tree(spark, sf_dir), _region_facet(), _node_keys(spark, sf_dir)))


@register("facet_type_bucket", _bucket_sql("hits_tree", {
    "Building": "type_alias = 'BUILDING'", "cars": "type_alias = 'AUTOMOBILE'", "none": "FALSE"}))
def facet_type_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = Facet("kind", "contentType", ranges=(
        FacetRange("Building"), FacetRange("cars", "Cars", "automobile"), FacetRange("none")))
    return _counts(FC.facet_type_bucket(T.hits_tree(spark, sf_dir), facet))


@register("facet_value_bucket", _bucket_sql("hits_parts", {
    "brand#1": "f_p_brand = 'Brand#1'", "second": "f_p_brand = 'Brand#2'"}))
def facet_value_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = Facet("b", "p_brand", ranges=(FacetRange("brand#1"), FacetRange("second", "", " BRAND#2 ")))
    return _counts(FC.facet_value_bucket(T.hits_parts(spark, sf_dir), facet))


_NUMBER_LABELS = """SELECT p_partkey, 'band' AS alias, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN p_size || '-' || p_size + 25
  WHEN 1 THEN 'Under ' || p_size WHEN 2 THEN 'over ' || p_retailprice WHEN 3 THEN p_size || '+'
  WHEN 4 THEN p_size || ' and above' WHEN 5 THEN 'less than ' || p_retailprice ELSE p_name END AS label, p_size, p_retailprice FROM part"""


@register(
    "infer_numeric_bounds",
    f"""SELECT p_partkey, CAST(CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN p_size WHEN 2 THEN p_retailprice WHEN 3 THEN p_size
        WHEN 4 THEN p_size END AS DOUBLE) AS lower,
      CAST(CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN p_size + 25 WHEN 1 THEN p_size WHEN 5 THEN p_retailprice END AS DOUBLE) AS upper
    FROM ({_NUMBER_LABELS})""",
)
def infer_numeric_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")
    kind = F.col("p_partkey") % 7
    label = (
        F.when(kind == 0, F.concat(size, F.lit("-"), (F.col("p_size") + 25).cast("string")))
        .when(kind == 1, F.concat(F.lit("Under "), size)).when(kind == 2, F.concat(F.lit("over "), price))
        .when(kind == 3, F.concat(size, F.lit("+"))).when(kind == 4, F.concat(size, F.lit(" and above")))
        .when(kind == 5, F.concat(F.lit("less than "), price)).otherwise(F.col("p_name"))
    )
    ranges = T.table(spark, sf_dir, "part").select("p_partkey", F.lit("band").alias("alias"), label.alias("label"))
    return FC.infer_numeric_bounds(ranges).select("p_partkey", "lower", "upper")


def _stamp(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@register(
    "infer_date_bounds",
    f"""SELECT o_orderkey, {_TS.format('lower')}, {_TS.format('upper')} FROM (SELECT o_orderkey,
      CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN make_timestamp(y, 1, 1, 0, 0, 0) WHEN 1 THEN n - INTERVAL 24 HOUR
        WHEN 2 THEN n - INTERVAL 7 DAY WHEN 3 THEN n - INTERVAL 30 DAY WHEN 4 THEN n - INTERVAL 1 YEAR END AS lower,
      CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN make_timestamp(y + 1, 1, 1, 0, 0, 0) WHEN 5 THEN NULL ELSE n END AS upper
      FROM (SELECT o_orderkey, year(o_orderdate) + 10 AS y, TIMESTAMP '{AS_OF}' AS n FROM orders))""",
)
def infer_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 6
    label = (
        F.when(kind == 0, F.concat(F.lit("Year "), F.year("o_orderdate") + 10)).when(kind == 1, "Last 24 hours")
        .when(kind == 2, "past-week").when(kind == 3, "30 days").when(kind == 4, "1y").otherwise("anything")
    )
    ranges = T.table(spark, sf_dir, "orders").select("o_orderkey", F.lit("when").alias("alias"), label.alias("label"))
    return FC.infer_date_bounds(ranges, AS_OF).select("o_orderkey", _stamp("lower"), _stamp("upper"))


@register(
    "relative_date_bounds",
    f"""SELECT event_id, {_TS.format('lower')}, {_TS.format('upper')} FROM (SELECT event_id,
      CASE CAST(event_id % 6 AS INT) WHEN 0 THEN n - INTERVAL (k) DAY WHEN 1 THEN n - INTERVAL (7 * k) DAY
        WHEN 2 THEN n - INTERVAL (k) MONTH WHEN 3 THEN n - INTERVAL (k) YEAR WHEN 4 THEN n - INTERVAL (k) HOUR END AS lower,
      CASE WHEN event_id % 6 = 5 THEN CAST(ts AS DATE) ELSE n END AS upper
      FROM (SELECT event_id, ts, event_id % 50 AS k, TIMESTAMP '{T.EVENTS_AS_OF}' AS n FROM events))""",
)
def relative_date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(u) for u in ("d", "w", "M", "y", "h", "x")]), (F.col("event_id") % 6).cast("int"))
    ranges = T.table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("Now-"), F.col("event_id") % 50, unit).alias("from_bound"),
        F.when(F.col("event_id") % 6 == 5, F.date_format("ts", "yyyyMMdd")).otherwise(" now ").alias("to_bound"),
    )
    return FC.relative_date_bounds(ranges, T.EVENTS_AS_OF).select("event_id", _stamp("lower"), _stamp("upper"))


FACETS = (PRICE, BRAND, TAGS, SIZE)


def _part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections per part query: none, one facet, two, an unmet requirement, an ad-hoc bucket."""
    ids = T.hits_parts(spark, sf_dir).select("query_id").distinct()
    kind = F.col("query_id") % 6

    def chosen(**values: list[str]) -> Column:
        parts = [x for a, vs in values.items() for x in (F.lit(a), F.array(*[F.lit(v) for v in vs]))]
        return F.create_map(*parts)

    filters = (
        F.when(kind == 0, chosen(PRICE=["P-LOW"])).when(kind == 1, chosen(brand=["brand#1", "Brand#2", "Brand#3"], price=["p-mid", "p-high"]))
        .when(kind == 2, chosen(tags=["promo"], size=["7"])).when(kind == 3, chosen(price=["930-960"]))
        .when(kind == 4, chosen(size=["7", "8", "9", "10", "11"], brand=["Brand#5", "Brand#6", "Brand#7", "Brand#8", "Brand#9"]))
        .otherwise(F.create_map().cast("map<string,array<string>>"))
    )
    return T.query_defaults(ids.select("query_id", F.lit("x").alias("term"), filters.alias("filters")))


_PASS = {
    "price": "CASE query_id % 6 WHEN 0 THEN n_price < 925 WHEN 1 THEN n_price >= 925 WHEN 3 THEN n_price >= 930 AND n_price < 960 ELSE TRUE END",
    "Brand": "CASE query_id % 6 WHEN 1 THEN f_p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') WHEN 4 THEN f_p_brand IN ('Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9') ELSE TRUE END",
    "tags": "CASE query_id % 6 WHEN 2 THEN type_alias = 'PROMO' ELSE TRUE END",
    "size": "CASE query_id % 6 WHEN 4 THEN n_size IN (7, 8, 9, 10, 11) ELSE TRUE END",
}


@register("apply_facet_filters", f"SELECT query_id, doc_key FROM hits_parts WHERE {' AND '.join(_PASS.values())}")
def apply_facet_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FC.apply_facet_filters(T.hits_parts(spark, sf_dir), _part_queries(spark, sf_dir), FACETS)
    return rows.select("query_id", "doc_key")


@register(
    "apply_facet_filters_min_active",
    f"SELECT query_id, doc_key FROM hits_parts WHERE query_id % 6 NOT IN (1, 2, 4) OR ({' AND '.join(_PASS.values())})",
)
def apply_facet_filters_min_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = FC.apply_facet_filters(T.hits_parts(spark, sf_dir), _part_queries(spark, sf_dir), FACETS, 2)
    return rows.select("query_id", "doc_key")


@register(
    "apply_facet_filters_places",
    """SELECT query_id, doc_key FROM hits_tree WHERE CASE query_id % 4 WHEN 0 THEN n_regionkey IN (0, 2) OR doc_key = '1' WHEN 1 THEN n_regionkey = 3
      WHEN 2 THEN n_nationkey = 7 ELSE TRUE END""",
)
def apply_facet_filters_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets, a key that names no bucket, and a bare node id."""
    hits = T.hits_tree(spark, sf_dir)
    kind = F.col("query_id") % 4
    chosen = (
        F.when(kind == 0, F.array(F.lit("Africa"), F.lit("asia"))).when(kind == 1, F.array(F.lit(_guid("EUROPE").upper())))
        .when(kind == 2, F.array(F.lit("107"))).otherwise(F.array().cast("array<string>"))
    )
    ids = hits.select("query_id").distinct()
    queries = T.query_defaults(ids.select("query_id", F.create_map(F.lit("Region"), chosen).alias("filters")))
    rows = FC.apply_facet_filters(hits, queries, [_region_facet()], node_keys=_node_keys(spark, sf_dir))
    return rows.select("query_id", "doc_key")


def _others(name: str) -> str:
    return " AND ".join(test for facet, test in _PASS.items() if facet != name)


_SELF = f"""
SELECT query_id, 'Brand' AS facet, f_p_brand AS value, count(*) AS n FROM hits_parts WHERE {_others('Brand')} GROUP BY ALL
UNION ALL SELECT query_id, 'tags', value, count(*) FROM (SELECT query_id, unnest(string_split(f_tags, ',')) AS value
  FROM hits_parts WHERE {_others('tags')}) GROUP BY ALL
UNION ALL SELECT query_id, 'size', CAST(n_size AS VARCHAR), count(*) FROM hits_parts WHERE {_others('size')} GROUP BY ALL
"""
_SELF = f"""SELECT query_id, facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, lower(value)) AS k
  FROM ({_SELF})) WHERE k <= CASE facet WHEN 'tags' THEN 5 WHEN 'size' THEN 50 ELSE 20 END
""" + "".join(
    f"UNION ALL SELECT query_id, 'price', '{a}', count(*) FILTER (WHERE ({t}) AND {_others('price')}) FROM hits_parts GROUP BY query_id\n"
    for a, t in _PRICE_TESTS.items()
)


def _self_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.facet_counts_excluding_self(T.hits_parts(spark, sf_dir), _part_queries(spark, sf_dir), FACETS)


@register("facet_counts_excluding_self", _SELF)
def facet_counts_excluding_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _self_counts(spark, sf_dir).withColumn("n", F.col("n").cast("bigint"))


@register(
    "facet_requires",
    """SELECT DISTINCT query_id, unnest(CASE query_id % 6 WHEN 0 THEN ['price'] WHEN 1 THEN ['price', 'Brand'] WHEN 2 THEN ['tags', 'size']
        WHEN 3 THEN ['price'] WHEN 4 THEN ['Brand', 'size'] ELSE [] END) AS facet,
      unnest(CASE query_id % 6 WHEN 0 THEN [''] WHEN 1 THEN ['', ''] WHEN 2 THEN ['', 'brand'] WHEN 3 THEN [''] WHEN 4 THEN ['', ''] ELSE [] END) AS waiting_for,
      unnest(CASE query_id % 6 WHEN 0 THEN [FALSE] WHEN 1 THEN [FALSE, FALSE] WHEN 2 THEN [FALSE, TRUE] WHEN 3 THEN [FALSE] WHEN 4 THEN [FALSE, FALSE] ELSE [] END) AS is_inert
    FROM hits_parts""",
)
def facet_requires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.facet_requires(_part_queries(spark, sf_dir), FACETS)


@register(
    "facet_min_active",
    """SELECT DISTINCT query_id, CASE query_id % 6 WHEN 0 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 0 ELSE 2 END AS active,
      query_id % 6 IN (1, 2, 4) AS narrows FROM hits_parts""",
)
def facet_min_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.facet_min_active(_part_queries(spark, sf_dir), 2)


@register(
    "facet_hide_empty",
    f"""SELECT query_id, facet, CASE facet WHEN 'price' THEN 'Price' WHEN 'Brand' THEN 'Brand' WHEN 'size' THEN 'Size' ELSE facet END AS facet_label,
      value, CASE value WHEN 'p-low' THEN 'Cheap' WHEN 'p-mid' THEN 'Middle' ELSE value END AS label, n,
      CASE query_id % 6 WHEN 0 THEN value = 'p-low' WHEN 1 THEN value IN ('p-mid', 'p-high') OR (facet = 'Brand' AND value IN ('Brand#1', 'Brand#2', 'Brand#3'))
        WHEN 2 THEN value = 'PROMO' OR (facet = 'size' AND value = '7')
        WHEN 4 THEN (facet = 'size' AND value IN ('7', '8', '9', '10', '11'))
          OR (facet = 'Brand' AND value IN ('Brand#5', 'Brand#6', 'Brand#7', 'Brand#8', 'Brand#9')) ELSE FALSE END AS is_selected
    FROM ({_SELF})""",
)
def facet_hide_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = FC.facet_hide_empty(_self_counts(spark, sf_dir), _part_queries(spark, sf_dir), FACETS)
    return shown.withColumn("n", F.col("n").cast("bigint"))
