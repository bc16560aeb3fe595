"""Registered queries: log reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import analytics as A
from findery.session import shared_folder
from findery.sources import logs as L
from findery.workload import tables as T
from findery.workload.registry import register

FROM, TO = "2024-01-03 00:00:00", "2024-01-28 12:00:00"
_IN = f"create_date >= TIMESTAMP '{FROM}' AND create_date < TIMESTAMP '{TO}'"

_REPORT = f"""
SELECT s.normalized_term AS term, count(*) AS searches,
  round(avg(s.result_count), 6) AS average_result_count,
  CAST(sum(CASE WHEN s.result_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_results,
  max(s.create_date) AS last_searched, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS clicks,
  round(coalesce(avg(c.pos), 0), 6) AS average_position,
  round(coalesce(sum(c.n), 0) / count(*), 6) AS click_rate
FROM search_log s LEFT JOIN (
  SELECT query_key, count(*) AS n, avg(position) AS pos FROM click_log GROUP BY query_key
) c ON c.query_key = s.query_key
WHERE s.create_date >= TIMESTAMP '{FROM}' AND s.create_date < TIMESTAMP '{TO}'
GROUP BY s.normalized_term
"""


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return T.search_log(spark, sf_dir), T.click_log(spark, sf_dir)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.term_report(*_logs(spark, sf_dir), FROM, TO)


register("term_report", _REPORT)(_report)


@register("top_terms", f"SELECT * FROM ({_REPORT}) ORDER BY searches DESC, term LIMIT 25")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_terms(_report(spark, sf_dir))


@register(
    "zero_result_terms",
    f"SELECT * FROM ({_REPORT}) WHERE zero_results > 0 ORDER BY searches DESC, term LIMIT 10",
)
def zero_result_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.zero_result_terms(_report(spark, sf_dir), 10)


@register(
    "unclicked_terms",
    f"""WITH clicks_of_busy AS (
      SELECT * FROM click_log WHERE query_key IN (SELECT query_key FROM search_log WHERE result_count < 3)),
    r AS ({_REPORT.replace('FROM click_log', 'FROM clicks_of_busy')
           .replace('s.normalized_term AS term', "s.normalized_term || '-' || s.duration_ms AS term")
           .replace('GROUP BY s.normalized_term', "GROUP BY s.normalized_term || '-' || s.duration_ms")})
    SELECT * FROM r WHERE clicks = 0 AND zero_results < searches
    ORDER BY searches DESC, term LIMIT 25""",
)
def unclicked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finer terms, and clicks only of searches with few results, so that some stay unclicked."""
    searches, clicks = _logs(spark, sf_dir)
    few = searches.filter("result_count < 3").select("query_key")
    finer = searches.withColumn(
        "normalized_term", F.concat_ws("-", "normalized_term", F.col("duration_ms").cast("string"))
    )
    return A.unclicked_terms(A.term_report(finer, clicks.join(few, "query_key", "left_semi"), FROM, TO))


@register(
    "log_summary",
    f"""SELECT s.total_searches, s.unique_terms, s.zero_result_searches,
      round(s.zero_result_searches / s.total_searches, 6) AS zero_result_rate,
      s.average_duration_ms, s.average_result_count, c.total_clicks,
      round(c.total_clicks / s.total_searches, 6) AS click_rate
    FROM (SELECT count(*) AS total_searches, count(DISTINCT normalized_term) AS unique_terms,
            CAST(sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_result_searches,
            round(avg(duration_ms), 6) AS average_duration_ms,
            round(avg(result_count), 6) AS average_result_count
          FROM search_log WHERE {_IN}) s
    CROSS JOIN (SELECT count(*) AS total_clicks FROM click_log WHERE {_IN}) c""",
)
def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_summary(*_logs(spark, sf_dir), FROM, TO)


@register(
    "click_stats",
    """SELECT query_key, count(*) AS clicks, round(avg(position), 6) AS average_position
    FROM click_log GROUP BY query_key""",
)
def click_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = A.click_stats(T.click_log(spark, sf_dir))
    return stats.withColumn("average_position", F.round("average_position", 6))


@register(
    "daily_volume",
    f"""SELECT strftime(create_date, '%Y-%m-%d') AS day, count(*) AS searches,
      CAST(sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_results
    FROM search_log WHERE {_IN} GROUP BY 1""",
)
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    volume = A.daily_volume(T.search_log(spark, sf_dir), FROM, TO)
    return volume.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "report_window",
    """SELECT query_key, term, result_count FROM search_log
    WHERE create_date >= TIMESTAMP '2024-01-14' AND create_date < TIMESTAMP '2024-01-21'""",
)
def report_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = A.report_window(T.search_log(spark, sf_dir), 7, as_of="2024-01-20 15:30:00")
    return kept.select("query_key", "term", "result_count")


_PURGED = """WITH old AS (SELECT query_key FROM search_log
                    WHERE create_date < TIMESTAMP '2024-02-01' - INTERVAL 12 DAY)
    SELECT 'search' AS kind, query_key, CAST(NULL AS VARCHAR) AS node_key FROM search_log
    WHERE query_key NOT IN (SELECT query_key FROM old)
    UNION ALL SELECT 'click', query_key, node_key FROM click_log
    WHERE query_key NOT IN (SELECT query_key FROM old)
    UNION ALL SELECT 'removed', count(*), NULL FROM old"""


def _survivors(searches: DataFrame, clicks: DataFrame, removed: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return (
        searches.select(F.lit("search").alias("kind"), "query_key", none.alias("node_key"))
        .unionByName(clicks.select(F.lit("click").alias("kind"), "query_key", "node_key"))
        .unionByName(removed.select(
            F.lit("removed").alias("kind"), F.col("removed").alias("query_key"), none.alias("node_key")
        ))
    )


@register("purge_log", _PURGED)
def purge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(*A.purge_log(*_logs(spark, sf_dir), 12, as_of=T.EVENTS_AS_OF))


@register("purge_log_tables", _PURGED)
def purge_log_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on the tables themselves: written by day, purged in place and read back."""
    base = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    for name, rows in zip(("searches", "clicks"), _logs(spark, sf_dir), strict=True):
        L.dated(rows).write.partitionBy("log_date").parquet(f"{base}/{name}")
    done = L.purge_log_tables(spark, f"{base}/searches", f"{base}/clicks", 12, as_of=T.EVENTS_AS_OF)
    removed = spark.range(1).select(F.lit(done.searches).cast("bigint").alias("removed"))
    return _survivors(spark.read.parquet(f"{base}/searches"), spark.read.parquet(f"{base}/clicks"), removed)
