"""Keep-first de-duplication per query, in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.functions import fields as X


def rank_order() -> list[Column]:
    """Best bets, then score; ties keep the order the indexes gave."""
    return [
        F.desc("is_best_bet"), F.desc("score"), F.asc("index_rank"), F.desc("raw_score"), F.asc("doc_key"),
    ]


def _keep_first(hits: DataFrame, value: Column) -> DataFrame:
    # Only the first row per value survives, so Spark limits each group before the shuffle.
    order = Window.partitionBy("query_id", "_value").orderBy(*rank_order())
    marked = hits.withColumn("_value", value)
    return marked.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_value")


def identity() -> Column:
    """A document's key, or its id where there is no key, ignoring case."""
    key, node = F.concat(F.lit("k:"), F.lower("doc_key")), F.concat(F.lit("i:"), F.col("node_id"))
    return F.coalesce(key, node)


def dedup_identity(hits: DataFrame) -> DataFrame:
    """The first row per key, or per id where there is no key, ignoring case."""
    return _keep_first(hits, identity())


def dedup_by_field(hits: DataFrame, field: str) -> DataFrame:
    """The first row per value of a field, ignoring case; rows without a value are all kept.

    A row without a value is a group of its own, so those rows spread out instead of meeting.
    """
    value = F.lower(X.sortable_value(field))
    alone = F.concat_ws("\u0001", F.lit(""), "index_name", "doc_key")
    return _keep_first(hits, F.when(F.coalesce(value, F.lit("")) == "", alone).otherwise(value))
