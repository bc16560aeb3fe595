"""Exact de-duplication through a stream's keyed state.

Each row is reduced to a fingerprint: the digest of its normalised text, its doc_id and length, and the
locator of its content (file and row). The fingerprints are read as a stream, in files of any order and
number, some at a time; the state, which lies on disk (RocksDB) and never expires, keeps for a digest how many rows came
and the identifier and locator of the row that stays. Rows are counted before they are shuffled, so a
digest that holds a third of all rows is as cheap as another. Hits, rows whose digest others share,
are then read again by locator and compared in full bytes; should texts of one digest differ, those rows
are grouped anew by their texts.

Texts are equal when they are after deleting ASCII white space. Of equal texts the row with the most code
points stays, then the smallest doc_id (null last), then the first by locator. A null text is an empty
one; empty texts are one group; repeated rows are told apart by their locators; texts of any length are compared whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.llm.common import located, without
from findery.session import shared_folder, store

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A partition's store is closed once its task is done: an open one holds files of some MB, even if near empty.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def best(*columns: str) -> Column:
    """The row that stays, first in order: most code points, smallest doc_id, first locator."""
    return F.min(F.struct(*columns)).alias("best")


ORDER = ("shorter", "no_id", "doc_id", "file", "row")


def fingerprints(placed: DataFrame, file: str, row: str, width: int) -> DataFrame:
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    return placed.select(
        (-F.length(whole)).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(file).alias("file"), F.col(row).alias("row"), sha.alias("sha"), F.substring(sha, 1, width).alias("digest"),
    )


def groups_of_stream(prints: DataFrame, folder: str, files_per_batch: int) -> DataFrame:
    """(digest, group_size, best) from the state, once the stream has taken every fingerprint in the folder."""
    spark = prints.sparkSession
    source = spark.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch)
    state = source.parquet(f"{folder}/prints").groupBy("digest").agg(F.count("*").alias("group_size"), best(*ORDER))
    with settings(spark, STATE):
        running = (
            state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
        kept = spark.read.format("statestore").load(f"{folder}/state")
        names = kept.schema["value"].dataType.names
        return store(
            kept.select("key.digest", F.col("value")[names[0]].alias("group_size"), F.col("value")[names[1]].alias("best"))
        )


#: Micro-batches that the fingerprints are taken in where nothing is said, so that later ones meet the state of earlier ones
#: and a failure costs a part.
BATCHES = 3


def members(docs: DataFrame, files_per_batch: int | None = None, width: int = 32) -> tuple[DataFrame, DataFrame, str, str]:
    """Every row's (file, row, doc_id, keep_id, group_size, kept, text_sha256), and docs with its locators.

    `width` is the number of digest bytes that key the state. A narrow one meets more texts in a key, which
    the comparison of full bytes parts again.
    """
    placed, file, row = located(docs)
    folder = f"{shared_folder(docs.sparkSession)}/dedup-{uuid.uuid4().hex}"
    fingerprints(placed, file, row, width).write.parquet(f"{folder}/prints")
    prints = docs.sparkSession.read.parquet(f"{folder}/prints")
    groups = groups_of_stream(prints, folder, files_per_batch or max(1, math.ceil(len(prints.inputFiles()) / BATCHES)))
    every = prints.join(groups, "digest")
    hits = every.where("group_size > 1").select("file", "row", "digest", "shorter", "no_id", "doc_id")
    content = placed.select(F.col(file).alias("file"), F.col(row).alias("row"), normalised(F.col("text")).alias("content"))
    read = hits.join(content, ["file", "row"])
    compared = read.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    clashes = store(compared.where("low <> high").select("digest"))
    if not clashes.isEmpty():
        mixed = read.join(clashes, "digest")
        parted = mixed.groupBy("digest", "content").agg(F.count("*").alias("group_size"), best(*ORDER))
        again = mixed.join(parted, ["digest", "content"]).select("file", "row", "group_size", "best")
        fixed = prints.join(again, ["file", "row"]).select(every.columns)
        every = every.join(clashes, "digest", "left_anti").unionByName(fixed)
    kept = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
    found = every.select(
        "file", "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return found, placed, file, row


def deduplicate(docs: DataFrame, files_per_batch: int | None = None, width: int = 32) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    return members(docs, files_per_batch, width)[0].drop("file", "row")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows that stay, columns as they were."""
    found, placed, file, row = members(docs)
    return without(placed, file, row, found.where("not kept"), docs.columns)
