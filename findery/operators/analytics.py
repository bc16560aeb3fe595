"""Reports over the search and click logs.

Every report aggregates by term or day with map-side combine first, so a term that makes up a
third of the log costs one row per task in the shuffle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from findery.functions.dates import as_of_literal


def in_range(from_ts: str, to_ts: str, col: str = "create_date") -> Column:
    return (F.col(col) >= as_of_literal(from_ts)) & (F.col(col) < as_of_literal(to_ts))


def report_bounds(as_of: str, days: int = 30) -> tuple[str, str]:
    """The last ``days`` whole UTC days, ending tomorrow at midnight."""
    days = max(days, 1)
    day = datetime.fromisoformat(as_of).replace(hour=0, minute=0, second=0, microsecond=0)
    end = day + timedelta(days=1)
    return str(end - timedelta(days=days)), str(end)


def report_window(searches: DataFrame, days: int = 30, *, as_of: str) -> DataFrame:
    return searches.filter(in_range(*report_bounds(as_of, days)))


def log_summary(searches: DataFrame, clicks: DataFrame, from_ts: str, to_ts: str) -> DataFrame:
    """Totals for a period. Clicks count by their own date.

    Grouping by term first makes the distinct count exact without moving the log itself.
    """
    zero = (F.col("result_count") == 0).cast("bigint")
    per_term = (
        searches.filter(in_range(from_ts, to_ts)).groupBy("normalized_term")
        .agg(
            F.count(F.lit(1)).alias("searches"), F.sum(zero).alias("zero_results"),
            F.sum("duration_ms").alias("duration"), F.count("duration_ms").alias("timed"),
            F.sum("result_count").alias("results"), F.count("result_count").alias("counted"),
        )
        .withColumn("terms", F.when(F.col("normalized_term").isNotNull(), 1).otherwise(0))
        .withColumn("clicks", F.lit(0).cast("bigint")).drop("normalized_term")
    )
    zeros = {c: F.lit(0).cast("bigint") for c in per_term.columns if c != "clicks"}
    click_total = (
        clicks.filter(in_range(from_ts, to_ts)).agg(F.count(F.lit(1)).alias("clicks"))
        .select(*[zeros.get(c, F.col("clicks")).alias(c) for c in per_term.columns])
    )
    total = per_term.unionByName(click_total).agg(
        *[F.sum(c).alias(c) for c in per_term.columns]
    )
    searched = F.col("searches")

    def ratio(top: Column, bottom: Column, missing: float | None) -> Column:
        return F.round(F.when(bottom > 0, top / bottom).otherwise(missing), 6)

    return total.select(
        searched.alias("total_searches"), F.col("terms").cast("bigint").alias("unique_terms"),
        F.col("zero_results").alias("zero_result_searches"),
        ratio(F.col("zero_results"), searched, 0.0).alias("zero_result_rate"),
        ratio(F.col("duration"), F.col("timed"), 0.0).alias("average_duration_ms"),
        ratio(F.col("results"), F.col("counted"), 0.0).alias("average_result_count"),
        F.col("clicks").alias("total_clicks"),
        ratio(F.col("clicks"), searched, 0.0).alias("click_rate"),
    )


def click_stats(clicks: DataFrame) -> DataFrame:
    """Clicks and mean position per search."""
    return clicks.groupBy("query_key").agg(
        F.count(F.lit(1)).alias("clicks"), F.avg("position").alias("average_position")
    )


def term_report(searches: DataFrame, clicks: DataFrame, from_ts: str, to_ts: str) -> DataFrame:
    """Per term: searches, results, clicks of those searches whenever they happened.

    The clicks are reduced to one row per search before the join, so the join cannot multiply
    searches; the position is the mean of the per-search means.
    """
    log = searches.filter(in_range(from_ts, to_ts)).select(
        "query_key", "normalized_term", "result_count", "create_date"
    )
    joined = log.join(click_stats(clicks), "query_key", "left")
    grouped = joined.groupBy(F.col("normalized_term").alias("term")).agg(
        F.count(F.lit(1)).alias("searches"),
        F.round(F.avg("result_count"), 6).alias("average_result_count"),
        F.sum((F.col("result_count") == 0).cast("bigint")).alias("zero_results"),
        F.max("create_date").alias("last_searched"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.round(F.coalesce(F.avg("average_position"), F.lit(0.0)), 6).alias("average_position"),
    )
    return grouped.withColumn("click_rate", F.round(F.col("clicks") / F.col("searches"), 6))


def _first(report: DataFrame, take: int) -> DataFrame:
    """The most searched terms; a top-n over one row per term."""
    return report.orderBy(F.desc("searches"), "term").limit(max(take, 1))


def top_terms(report: DataFrame, take: int = 25) -> DataFrame:
    return _first(report, take)


def zero_result_terms(report: DataFrame, take: int = 25) -> DataFrame:
    return _first(report.filter("zero_results > 0"), take)


def unclicked_terms(report: DataFrame, take: int = 25) -> DataFrame:
    return _first(report.filter("clicks = 0 AND zero_results < searches"), take)


def daily_volume(searches: DataFrame, from_ts: str, to_ts: str) -> DataFrame:
    """Searches and zero-result searches per day; days without any are absent."""
    return (
        searches.filter(in_range(from_ts, to_ts))
        .groupBy(F.to_date("create_date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("searches"),
            F.sum((F.col("result_count") == 0).cast("bigint")).alias("zero_results"),
        )
    )


def purge_log(
    searches: DataFrame, clicks: DataFrame, days: int = 90, *, as_of: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Surviving searches, surviving clicks, and the number of searches removed.

    Clicks go with their search; clicks of no known search stay. 0 days keeps everything.
    """
    cutoff = as_of_literal(as_of) - F.make_interval(days=F.lit(days))
    old = (F.col("create_date") < cutoff) if days > 0 else F.lit(False)
    removed = searches.filter(old)
    return (
        searches.filter(~old),
        clicks.join(removed.select("query_key"), "query_key", "left_anti"),
        removed.agg(F.count(F.lit(1)).alias("removed")),
    )
