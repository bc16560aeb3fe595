"""Connected components of a link table, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.session import store


def _minima(links: DataFrame) -> DataFrame:
    """(node, least) with the least of a node and its neighbours; links hold both directions."""
    return links.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the smallest node that it is connected with.

    Rounds of two steps until nothing changes: larger neighbours of a node are tied to the least of its
    neighbourhood, then the node and its smaller neighbours are. A tree's depth falls by a constant factor
    a round. Each round is written to the shared folder; hot nodes are minima before they are shuffled,
    and their joins are split by adaptive execution. Nulls and loops are no links.
    """
    edges = store(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = both.join(_minima(both), "node").where("other > node").select(
            F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        least = large.groupBy("node").agg(F.min("other").alias("least"))
        joined = large.join(least, "node")
        small = (
            joined.select("node", F.col("least").alias("other"))
            .unionByName(joined.where("other > least").select(F.col("other").alias("node"), F.col("least").alias("other")))
            .distinct()
        )
        after = store(small)
        edges, before = after, mark
        mark = _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("other").alias("node")).distinct()
    stars = edges.groupBy("node").agg(F.min("other").alias("root"))
    return stars.unionByName(roots.join(stars, "node", "left_anti").select("node", F.col("node").alias("root")))
