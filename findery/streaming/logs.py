"""Search and click logs as streams: continuous ingest and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from findery.sources.logs import LogSettings, dated, searches_to_log

FLUSH_EVERY = "5 seconds"


def stream_search_log(
    src: DataFrame, path: str, checkpoint: str, settings: LogSettings = LogSettings(), *, available_now: bool = False
) -> StreamingQuery:
    """Continuous ingest with the recording rules; the file sink writes every row exactly once."""
    rows = dated(searches_to_log(src, settings))
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("log_date")
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_EVERY}
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _counts() -> list:
    return [
        F.count(F.lit(1)).alias("searches"),
        F.sum((F.col("result_count") == 0).cast("bigint")).alias("zero_results"),
    ]


def _timed(src: DataFrame, delay: str) -> DataFrame:
    # Watermarks are kept on zoned timestamps; the session runs in UTC.
    return src.withColumn("create_date", F.col("create_date").cast("timestamp")).withWatermark("create_date", delay)


def stream_daily_volume(src: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Searches and zero-result searches per day; rows later than ``delay`` are dropped."""
    days = _timed(src, delay).groupBy(F.window("create_date", "1 day").alias("w")).agg(*_counts())
    return days.select(F.col("w.start").alias("day"), "searches", "zero_results")


def stream_term_counts(src: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same per normalised term and day."""
    days = _timed(src, delay).groupBy(
        F.window("create_date", "1 day").alias("w"), "normalized_term"
    ).agg(*_counts())
    return days.select(F.col("w.start").alias("day"), F.col("normalized_term").alias("term"), "searches", "zero_results")


def stream_click_attribution(
    searches: DataFrame, clicks: DataFrame, wait: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Searches with each of their clicks; an unclicked search comes out once, after the wait."""
    asked = _timed(searches, delay).select("query_key", F.col("normalized_term").alias("term"), F.col("create_date").alias("searched_at"))
    clicked = _timed(clicks, delay).select(
        F.col("query_key").alias("clicked_key"), "node_key", "position", F.col("create_date").alias("clicked_at")
    )
    on = (
        (F.col("query_key") == F.col("clicked_key")) & (F.col("clicked_at") >= F.col("searched_at"))
        & (F.col("clicked_at") <= F.col("searched_at") + F.expr(f"INTERVAL {wait}"))
    )
    return asked.join(clicked, on, "left_outer").drop("clicked_key")
