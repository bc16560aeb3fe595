"""Lookups in a document's open field map, whose keys are lower-cased when it is loaded."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from findery.functions.text import SPACE

# Stored field names with a meaning of their own, lower-cased.
PUBLISHED = "__published"
NODE_NAME = "nodename"
SYSTEM_NODE_NAME = "__nodename"
SORT_PREFIX = "__sort_"
RAW_PREFIX = "__raw_"
EXTRACTED = "extractedcontent"
CREATE_DATE = "createdate"
UPDATE_DATE = "updatedate"
NAVI_HIDE = "umbraconavihide"

# Request names for the built-in columns, lower-cased.
BUILT_IN_NAMES = {
    "nodename": "name", "name": "name",
    "__nodetypealias": "type_alias", "contenttypealias": "type_alias", "contenttype": "type_alias",
    "__key": "doc_key", "key": "doc_key",
    "__nodeid": "node_id", "id": "node_id",
    "__path": "path", "path": "path",
}

# Bookkeeping field names that are never content, lower-cased.
METADATA_FIELDS = [
    "id", "nodetype", "templateid", "icon", "creatorid", "creatorname", "writerid", "writername",
    "level", "parentid", "sortorder", "path", "createdate", "updatedate", "published", "trashed",
    "urlname", "umbraconavihide", "loginname",
]

# Field names every result keeps.
ALWAYS_RETURNED = ["nodename", "__nodename", "__nodetypealias", "createdate", "updatedate"]


def truthy(col: Column) -> Column:
    """``1``, ``y`` or ``true``; false for null."""
    return F.coalesce((col == "1") | F.lower(col).isin("y", "true"), F.lit(False))


def stored(field: str, fields: str = "fields") -> Column:
    """The stored value of one field, null when the document has none."""
    return F.try_element_at(F.col(fields), F.lit(field.lower()))


def variants(field: str, fields: str = "fields") -> Column:
    """Values of the field's culture variants, in field-name order."""
    prefix = field.lower() + "_"
    entries = F.array_sort(F.map_entries(F.map_filter(fields, lambda k, v: k.startswith(prefix))))
    return F.transform(entries, lambda e: e["value"])


def variant_value(field: str, fields: str = "fields") -> Column:
    """The first culture variant that is not blank."""
    filled = F.filter(variants(field, fields), lambda v: v.rlike(f"[^{SPACE}]"))
    return F.get(filled, F.lit(0))


def built_in(name: str) -> Column | None:
    column = BUILT_IN_NAMES.get(name.lower())
    if column is None:
        return None
    if column == "path":
        return F.array_join(F.col("path").cast("array<string>"), ",")
    return F.col(column).cast("string")


def field_value(field: str) -> Column:
    """The stored field when there is one, else the built-in column of that name."""
    own = built_in(field)
    return stored(field) if own is None else F.coalesce(stored(field), own)


def sortable_value(field: str) -> Column:
    """The built-in column of that name, else the sort twin, else the field."""
    own = built_in(field)
    return own if own is not None else F.coalesce(stored(SORT_PREFIX + field), field_value(field))


def facet_value(field: str) -> Column:
    return F.coalesce(field_value(field), sortable_value(field))


def flag_set(field: str) -> Column:
    """The plain field decides when present; only when absent may a culture variant set the flag."""
    plain = stored(field)
    return F.when(plain.isNotNull(), truthy(plain)).otherwise(
        F.exists(variants(field), lambda v: truthy(v))
    )
