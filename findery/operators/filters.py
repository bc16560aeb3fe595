"""Source rules: what may be found at all."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions import fields as X
from findery.rules import RuleSet, text_array

HIT_KEY = ["query_id", "index_name", "doc_key"]


def _key(rows: DataFrame) -> list[str]:
    return [c for c in HIT_KEY if c in rows.columns]


def type_included(rules: RuleSet) -> Column:
    """Include means include: nothing listed lets nothing through."""
    kind, alias = F.lower("index_type"), F.lower("type_alias")
    content, media = text_array(rules.include_content_types), text_array(rules.include_media_types)
    return (
        ((kind == "content") & F.array_contains(content, alias))
        | ((kind == "media") & F.array_contains(media, alias))
        | ((kind == "member") & F.lit(rules.include_members))
    )


def type_not_excluded(rules: RuleSet) -> Column:
    return ~F.coalesce(
        F.array_contains(text_array(rules.exclude_types), F.lower("type_alias")), F.lit(False)
    )


def type_gate(docs: DataFrame, rules: RuleSet) -> DataFrame:
    return docs.filter(type_included(rules))


def type_exclude(docs: DataFrame, rules: RuleSet) -> DataFrame:
    return docs.filter(type_not_excluded(rules))


def _nodes(values: Sequence[int]) -> DataFrame:
    table = pa.table({"node_id": pa.array([int(v) for v in values], pa.int64())})
    return SparkSession.active().createDataFrame(table)


def _touching(hits: DataFrame, nodes: DataFrame, ids: Column) -> DataFrame:
    """Keys of the hits with one of the nodes among their ids."""
    exploded = hits.select(*_key(hits), F.explode(ids).alias("node"))
    listed = nodes.select(F.col("node_id").cast("bigint").alias("node"))
    return exploded.join(listed, "node", "left_semi").select(*_key(hits)).distinct()


def filter_subtree(hits: DataFrame, roots: Sequence[int] | DataFrame) -> DataFrame:
    """Rows with a root on their path. The roots are joined, however many they are."""
    if isinstance(roots, DataFrame):
        return hits.join(_touching(hits, roots, F.col("path")), _key(hits), "left_semi")
    if not roots:
        return hits
    return filter_subtree(hits, _nodes(roots))


def filter_excluded_nodes(
    hits: DataFrame, nodes: Sequence[int] | DataFrame, descendants: bool = True
) -> DataFrame:
    """Drops excluded nodes and, by default, everything below them."""
    node_ids = F.array("node_id")
    ids = F.concat(node_ids, F.coalesce("path", F.array().cast("array<bigint>"))) if descendants else node_ids
    if isinstance(nodes, DataFrame):
        return hits.join(_touching(hits, nodes, ids), _key(hits), "left_anti")
    if not nodes:
        return hits
    return filter_excluded_nodes(hits, _nodes(nodes), descendants)


def is_hidden(flag_fields: Sequence[str]) -> Column:
    hidden = F.lit(False)
    for field in flag_fields:
        if field.strip():
            hidden = hidden | X.flag_set(field.strip())
    return hidden


def filter_flags(hits: DataFrame, flag_fields: Sequence[str]) -> DataFrame:
    return hits.filter(~is_hidden(flag_fields))


def is_unpublished() -> Column:
    value = X.stored(X.PUBLISHED)
    return F.coalesce((value != "") & ~X.truthy(value), F.lit(False))


def filter_published(hits: DataFrame) -> DataFrame:
    """Only a stated, falsy flag drops a row; a missing one keeps it."""
    return hits.filter(~is_unpublished())


def filter_protected(hits: DataFrame, protected_nodes: DataFrame) -> DataFrame:
    """Drops rows with a protected node on their path; a failed lookup counts as protected."""
    closed = protected_nodes.filter(F.coalesce("is_protected", F.lit(True)))
    return hits.join(_touching(hits, closed, F.col("path")), _key(hits), "left_anti")


def filter_min_score(hits: DataFrame, minimum: float, browsing: DataFrame | None = None) -> DataFrame:
    """Best bets always stay. A threshold of 0 or less keeps everything.

    Rows of ``browsing`` queries (query_id) have no relevance, so the threshold does not concern them.
    """
    if minimum <= 0:
        return hits
    high = F.col("is_best_bet") | (F.col("score") >= minimum)
    if browsing is None:
        return hits.filter(high)
    marked = browsing.select("query_id", F.lit(True).alias("_browse")).distinct()
    return hits.join(marked, "query_id", "left").filter(high | F.col("_browse")).drop("_browse")


def trim_fields(hits: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Cuts the field map to the wanted names and those every result carries; none keeps all."""
    if not keep:
        return hits
    names = text_array([*keep, *X.ALWAYS_RETURNED])
    return hits.withColumn("fields", F.map_filter("fields", lambda k, v: F.array_contains(names, k)))
