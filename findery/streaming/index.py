"""A search index kept up to date by a stream of document changes.

Every micro-batch writes three small tables under its batch id: the postings of the documents it brings, the keys of all
documents it touches, and the changes it makes to vocabulary and statistics: what its new postings add, less what the
touched documents had before. A document's live postings are those of the last batch that touched it, so older ones
and deletions need no rewriting. Nothing of a batch reads that batch or later ones, and its folders are
overwritten whole, so a batch repeated after a failure replaces itself.

A change has the columns of a document, and ``version`` and ``is_deleted``. Of several changes to a document in a batch
the highest version counts; a batch is newer than those before it whatever its versions are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from findery.operators.forward import PLACE
from findery.operators.postings import KEYS, POSTINGS, SearchIndex, build_postings
from findery.session import store
from findery.sources.indexes import searchable_name

CHANGE_COLUMNS = ["version", "is_deleted"]
TOUCHED = "index_name string, doc_key string"
COUNTS = "index_name string, field string, term string, df bigint, tf bigint, docs bigint"


def _read(spark: SparkSession, path: str, name: str, schema: str, before: int | None) -> DataFrame:
    """A table of all batches, or of those before one; empty where no batch has been."""
    columns = f"{schema}, batch_id bigint"
    try:
        rows = spark.read.schema(columns).parquet(f"{path}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], columns)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def live_postings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Postings of each document's last batch. Touched keys are narrow; only they are grouped."""
    last = _read(spark, path, "touched", TOUCHED, before).groupBy(*PLACE).agg(F.max("batch_id").alias("batch_id"))
    return _read(spark, path, "postings", POSTINGS, before).join(last, [*PLACE, "batch_id"], "left_semi").drop("batch_id")


def _counts(postings: DataFrame, sign: int) -> DataFrame:
    """What postings add to (or take from) the counts of each term of a field."""
    return postings.groupBy(*KEYS, "term").agg(
        (sign * F.count(F.lit(1))).alias("df"), (sign * F.sum("tf")).cast("bigint").alias("tf"),
        (sign * F.sum(F.col("is_first").cast("bigint"))).alias("docs"))


def only_named(changes: DataFrame, names: list[str] | None, variants: bool) -> DataFrame:
    """Changes with the fields that are indexed; without names, all of them."""
    if not names:
        return changes
    lowered = sorted({n.lower() for n in names})

    def wanted(key: Column, _: Column) -> Column:
        found = key.isin(lowered)
        for name in lowered if variants else []:
            found = found | key.startswith(name + "_")
        return found

    return changes.withColumn("fields", F.map_filter("fields", wanted))


def apply_changes(changes: DataFrame, path: str, batch_id: int, names: list[str] | None, variants: bool = True) -> None:
    """One batch of changes into the index at ``path``."""
    spark = changes.sparkSession
    # A repeated row is one change: equal versions are told apart by nothing that the index would show.
    # Spark keeps one change a document and task before the only shuffle of whole documents.
    order = Window.partitionBy(*PLACE).orderBy(F.desc("version"), F.asc("is_deleted"))
    latest = store(only_named(changes, names, variants).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n"))
    touched = latest.select(*PLACE)
    touched.write.mode("overwrite").parquet(f"{path}/touched/batch_id={batch_id}")
    present = latest.filter(~F.coalesce("is_deleted", F.lit(False))).drop(*CHANGE_COLUMNS)
    build_postings(present, names, variants).postings.write.mode("overwrite").parquet(f"{path}/postings/batch_id={batch_id}")
    new = spark.read.schema(POSTINGS).parquet(f"{path}/postings/batch_id={batch_id}")
    old = live_postings(spark, path, batch_id).join(touched, PLACE, "left_semi")
    changed = _counts(new, 1).unionByName(_counts(old, -1)).groupBy(*KEYS, "term").agg(*[F.sum(c).alias(c) for c in ("df", "tf", "docs")])
    changed.write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")


def stream_index(
    changes: DataFrame, path: str, checkpoint: str, names: list[str] | None = None, *, variants: bool = True, available_now: bool = False
) -> StreamingQuery:
    """Keeps the index at ``path`` up to date with a stream of changes."""
    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    writer = changes.writeStream.foreachBatch(lambda batch, batch_id: apply_changes(batch, path, batch_id, names, variants))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_streamed_index(spark: SparkSession, path: str) -> SearchIndex:
    """The index as the last batch left it: live postings, and counts summed over batches."""
    counts = _read(spark, path, "counts", COUNTS, None).groupBy(*KEYS, "term").agg(*[F.sum(c).alias(c) for c in ("df", "tf", "docs")])
    stats = counts.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tf").alias("tf")).filter("n_docs > 0")
    stats = stats.select(*KEYS, "n_docs", (F.col("tf") / F.col("n_docs")).alias("avg_len")).withColumn("is_searchable", searchable_name(F.col("field")))
    return SearchIndex(live_postings(spark, path), counts.filter("df > 0").select(*KEYS, "term", "df"), stats)


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The streamed index as a kept one: each live posting once, sorted into tables by index and field."""
    read_streamed_index(spark, path).write(target)
