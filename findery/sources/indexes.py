"""Indexes: reading them, counting them, and the catalogue of their fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions import fields as X, text as T

# Declared types that are searchable, and those that sort.
SEARCHABLE_TYPES = ["fulltext", "fulltextsortable", "invariantcultureignorecase", "emailaddress"]
SORTABLE_TYPES = ["fulltextsortable", "int", "long", "float", "double", "datetime"]
DEFAULT_TYPE = "fulltext"


@dataclass(frozen=True)
class IndexSpec:
    """A named index kept as parquet files of the document shape."""

    name: str
    path: str


def index_order(specs: Sequence[IndexSpec], order: Sequence[str] | None, preferred: str) -> list[IndexSpec]:
    """The asked-for indexes that exist, repeats dropped; none asked for means all, preferred first."""
    by_name = {s.name.lower(): s for s in specs}
    if not order:
        return sorted(by_name.values(), key=lambda s: (s.name.lower() != preferred.lower(), s.name.lower()))
    asked = dict.fromkeys(name.lower() for name in order)
    return [by_name[name] for name in asked if name in by_name]


def tag_indexes(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    out = None
    for rank, (name, frame) in enumerate(frames):
        tagged = frame.withColumns({"index_name": F.lit(name), "index_rank": F.lit(rank)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def scan_indexes(
    spark: SparkSession, specs: Sequence[IndexSpec], order: Sequence[str] | None = None, preferred: str = ""
) -> DataFrame:
    """Every chosen index as one frame with ``index_name`` and ``index_rank``."""
    chosen = index_order(specs, order, preferred)
    return tag_indexes([(s.name, spark.read.parquet(s.path)) for s in chosen])


def index_stats(docs: DataFrame) -> DataFrame:
    """Documents and distinct fields per index; healthy when it holds any document.

    One pass: a document counts itself once under the empty field name.
    """
    names = F.array_union(F.array(F.lit("")), F.map_keys("fields"))
    per_field = docs.select("index_name", F.explode(names).alias("field")).groupBy("index_name", "field").count()
    own = F.col("field") == ""
    return per_field.groupBy("index_name").agg(
        F.coalesce(F.sum(F.when(own, F.col("count"))), F.lit(0)).alias("document_count"),
        F.count(F.when(~own, 1)).alias("field_count"),
    ).withColumn("is_healthy", F.col("document_count") > 0)


def searchable_name(name: Column) -> Column:
    """Whether a stored field of undeclared type is searched where a profile names no fields."""
    return _is_searchable(name, F.lit(DEFAULT_TYPE))


def _is_searchable(name: Column, kind: Column) -> Column:
    return F.when(name.startswith("__"), name == X.SYSTEM_NODE_NAME).otherwise(
        ~name.isin(X.METADATA_FIELDS) & F.lower(kind).isin(SEARCHABLE_TYPES)
    )


def discover_fields(docs: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """The field catalogue of each index, from all documents.

    A sort twin counts towards the field it belongs to, so one aggregation over field names is
    enough. It keeps only the lowest id with a filled value; that one value per field is fetched
    afterwards, so no text passes through the aggregation.
    """
    declared = {k.lower(): v for k, v in (declared or {}).items()}
    rows = docs.select("index_name", "node_id", F.explode("fields").alias("stored_name", "value"))
    rows = rows.filter(~F.col("stored_name").startswith(X.RAW_PREFIX))
    twin = F.col("stored_name").startswith(X.SORT_PREFIX)
    base = F.when(twin, F.substr(F.col("stored_name"), F.lit(len(X.SORT_PREFIX) + 1))).otherwise(F.col("stored_name"))
    filled = ~twin & (F.trim("value") != "")
    counted = rows.groupBy("index_name", base.alias("field")).agg(
        F.bool_or(twin).alias("has_twin"), F.bool_or(~twin).alias("is_stored"),
        F.min(F.when(filled, F.col("node_id"))).alias("sample_id"),
    ).filter("is_stored")
    samples = rows.select(
        "index_name", F.col("stored_name").alias("field"), F.col("node_id").alias("sample_id"), F.col("value").alias("sample")
    )
    keys = ["index_name", "field", "sample_id"]
    wanted = counted.select(*keys).filter("sample_id IS NOT NULL")
    found = counted.join(samples.join(wanted, keys, "left_semi"), keys, "left")
    pairs = [x for k, v in declared.items() for x in (F.lit(k), F.lit(v))]
    kinds = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    kind = F.coalesce(F.try_element_at(kinds, F.col("field")), F.lit(DEFAULT_TYPE))
    return found.select(
        "index_name", "field", kind.alias("type"), F.col("field").startswith("__").alias("is_system"),
        _is_searchable(F.col("field"), kind).alias("is_searchable"),
        (F.col("has_twin") | F.lower(kind).isin(SORTABLE_TYPES)).alias("is_sortable"),
        F.coalesce(T.looks_structured(F.col("sample")), F.lit(False)).alias("looks_structured"),
        ((F.col("field") == X.EXTRACTED) | F.col("field").startswith(X.EXTRACTED + "_")).alias("is_extracted"),
        "sample",
    )


def list_types(docs: DataFrame) -> DataFrame:
    """Distinct type aliases per index type."""
    return docs.select("index_type", "type_alias").distinct()


def list_cultures(docs: DataFrame, default: str = "") -> DataFrame:
    """Distinct cultures, the default one marked (and first when ordered by ``is_default``)."""
    cultures = docs.filter("culture IS NOT NULL").select("culture").distinct()
    return cultures.withColumn("is_default", F.lower("culture") == default.lower())
