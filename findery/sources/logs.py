"""The search and click logs as date-partitioned parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions.dates import as_of_literal
from findery.functions.text import collapse_spaces, normalize_term
from findery.session import settings, store

AD_HOC = "ad-hoc"

# Column widths of the log tables.
SEARCH_WIDTHS = {"profile_alias": 255, "term": 500, "normalized_term": 500, "culture": 20}
CLICK_WIDTHS = {"node_name": 255}
LOG_COLUMNS = [
    "query_key", "profile_alias", "term", "normalized_term", "result_count", "duration_ms", "culture", "create_date",
]


@dataclass(frozen=True)
class LogSettings:
    enabled: bool = True
    minimum_term_length: int = 2
    zero_results_only: bool = False
    track_clicks: bool = True


def truncate_columns(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, n) for c, n in widths.items() if c in df.columns})


def searches_to_log(searches: DataFrame, settings: LogSettings = LogSettings()) -> DataFrame:
    """The rows worth recording, trimmed, normalised and cut to the log's widths."""
    term = F.trim("term")
    keep: Column = F.lit(settings.enabled) & ~F.col("profile_alias").eqNullSafe(AD_HOC)
    keep = keep & (F.length(term) >= max(1, settings.minimum_term_length))
    if settings.zero_results_only:
        keep = keep & (F.col("result_count") == 0)
    rows = searches.filter(keep & (collapse_spaces(F.col("term")) != ""))
    rows = rows.withColumns({"term": term, "normalized_term": normalize_term(F.col("term"))})
    return truncate_columns(rows.select(*LOG_COLUMNS), SEARCH_WIDTHS)


def clicks_to_log(clicks: DataFrame, settings: LogSettings = LogSettings()) -> DataFrame:
    rows = clicks.filter(F.lit(settings.enabled and settings.track_clicks) & F.col("query_key").isNotNull())
    return truncate_columns(rows, CLICK_WIDTHS)


def dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("log_date", F.to_date("create_date"))


def _append(rows: DataFrame, path: str) -> None:
    # A hot date is written by many tasks: as many slices as shuffle partitions, of which adaptive execution joins small ones.
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dated(rows).repartition("log_date", F.pmod(F.xxhash64("query_key"), F.lit(slices)))
    spread.write.mode("append").partitionBy("log_date").parquet(path)


def write_search_log(searches: DataFrame, path: str, settings: LogSettings = LogSettings()) -> DataFrame:
    """Appends the recorded searches and returns them."""
    rows = searches_to_log(searches, settings)
    _append(rows, path)
    return rows


def write_click_log(clicks: DataFrame, path: str, settings: LogSettings = LogSettings()) -> DataFrame:
    rows = clicks_to_log(clicks, settings)
    _append(rows, path)
    return rows


@dataclass(frozen=True)
class Purged:
    """How many rows a purge removed, and the days it dropped as whole partitions."""

    searches: int
    clicks: int
    dropped_days: tuple[str, ...]


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _days(spark: SparkSession, path: str) -> list[str]:
    """The days a table has partitions of, from its folder."""
    files, where = _file_system(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(n.removeprefix("log_date=") for n in names if n.startswith("log_date=") and not n.endswith("__"))


def _drop_day(spark: SparkSession, path: str, day: str) -> None:
    files, where = _file_system(spark, f"{path}/log_date={day}")
    files.delete(where, True)


def _rewrite(spark: SparkSession, path: str, days: list[str], kept: DataFrame) -> list[str]:
    """Puts ``kept`` in the place of some days' rows; days without any are dropped, and named."""
    rows = store(kept)
    with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        rows.write.mode("overwrite").partitionBy("log_date").parquet(path)
    left = {str(r.log_date) for r in rows.select("log_date").distinct().collect()}
    gone = [d for d in days if d not in left]
    for day in gone:
        _drop_day(spark, path, day)
    return gone


def purge_log_tables(spark: SparkSession, search_path: str, click_path: str, days: int = 90, *, as_of: str) -> Purged:
    """Removes searches older than ``days`` and their clicks from the tables that the writers keep.

    Whole days go as partitions, unread but for their keys; the border day is rewritten by dynamic partition overwrite, and so are the
    days of clicks on removed searches. Clicks go first, so a purge that is interrupted finds the same searches again;
    run twice it changes nothing. 0 days keeps everything; clicks of no known search stay.
    """
    known = _days(spark, search_path)
    if days <= 0 or not known:
        return Purged(0, 0, ())
    cutoff = as_of_literal(as_of) - F.make_interval(days=F.lit(days))
    border = spark.range(1).select(F.to_date(cutoff).cast("string")).first()[0]
    whole, old = [d for d in known if d < border], F.col("create_date") < cutoff
    searches = spark.read.parquet(search_path)
    aged = store(searches.filter((F.col("log_date") <= F.lit(border).cast("date")) & old).select("query_key", "log_date"))
    removed = aged.count()
    dropped, removed_clicks = list(whole), 0
    if removed and _days(spark, click_path):
        clicks, keys = spark.read.parquet(click_path), aged.select("query_key").distinct()
        hit = clicks.join(keys, "query_key", "left_semi").groupBy("log_date").agg(F.count(F.lit(1)).alias("n")).collect()
        touched = [str(r.log_date) for r in hit]
        removed_clicks = sum(r.n for r in hit)
        if touched:
            here = clicks.filter(F.col("log_date").cast("string").isin(touched))
            _rewrite(spark, click_path, touched, here.join(keys, "query_key", "left_anti").select(*clicks.columns))
    if border in known and not aged.filter(F.col("log_date") == F.lit(border).cast("date")).isEmpty():
        kept = searches.filter((F.col("log_date") == F.lit(border).cast("date")) & ~F.coalesce(old, F.lit(False)))
        dropped += _rewrite(spark, search_path, [border], kept)
    for day in whole:
        _drop_day(spark, search_path, day)
    return Purged(removed, removed_clicks, tuple(dropped))
