"""Set operations over hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from findery.session import store


def merge_indexes_first_wins(matches: DataFrame) -> DataFrame:
    """One row per node and index type; the earlier index wins."""
    order = Window.partitionBy("query_id", "node_id", "index_type").orderBy("index_rank", "doc_key")
    return matches.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def fallback_union(
    queries: DataFrame, plans: DataFrame, run: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Queries whose inferred filters left nothing are run again without them.

    ``plans`` holds the rewritten queries; those that had filters added and found nothing fall
    back to the filters the visitor chose. The first run is written once; both its rows and what it found are read from there.
    """
    first = store(run(plans))
    found = first.select("query_id").distinct()
    chosen = queries.select("query_id", F.col("filters").alias("own_filters"))
    narrowed = plans.join(chosen, "query_id").filter(
        F.size(F.array_except(F.map_keys("filters"), F.map_keys("own_filters"))) > 0
    )
    again = narrowed.join(found, "query_id", "left_anti").withColumn("filters", F.col("own_filters"))
    return first.unionByName(run(again.select(*plans.columns)))
