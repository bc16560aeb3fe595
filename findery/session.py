"""Session settings the jobs rely on, and the shared folder for cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

# Timestamps are UTC without a zone; adaptive execution splits skewed joins and merges small
# partitions, so the partition count only has to be high enough.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A frequent key's rows are split from the size on that partitions are meant to have, not from four times that.
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    # Rows handed to Python come in batches bounded by count and bytes, so that long texts cannot fill a worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # This rule repeats an exploded array's expression in a filter below the explode. Arrays here
    # are whole texts cut into words, so that would do the work twice to drop a few empty rows.
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@lru_cache(maxsize=None)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir for intermediate tables.

    A session of one process (master `local`) that names none gets a folder of its own; on a cluster
    that is an error, because executors and driver do not share local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master == "local" or master.startswith("local["):
        return _local_folder()
    raise ValueError("name a folder that all executors share in spark.checkpoint.dir")


def store(frame: DataFrame, *partition_by: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back: its lineage ends there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
