"""URL paths and node paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Last path segments and alias endings of a search page.
SEARCH_SEGMENTS = [
    "search", "searchresults", "search-results", "site-search", "sitesearch", "search-page",
    "searchpage", "find",
]
SEARCH_ALIAS_ENDINGS = ["search", "page", "result", "results"]


def normalize_path(col: Column) -> Column:
    """Lower-case path without query, fragment or trailing slash; empty when it leaves the site."""
    cut = F.trim(F.regexp_replace(F.trim(F.coalesce(col, F.lit(""))), r"(?s)[?#].*$", ""))
    rooted = F.when(cut.startswith("/"), cut).otherwise(F.concat(F.lit("/"), cut))
    bare = F.regexp_replace(rooted, "(?<=.)/+$", "")
    return F.when((cut == "") | rooted.startswith("//"), F.lit("")).otherwise(F.lower(bare))


def last_segment(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def is_search_alias(col: Column) -> Column:
    letters = F.lower(F.regexp_replace(F.coalesce(col, F.lit("")), r"[^\p{L}]", ""))
    return letters.contains("search") & letters.rlike(f"(?:{'|'.join(SEARCH_ALIAS_ENDINGS)})$")


def is_search_segment(col: Column) -> Column:
    return F.lower(F.coalesce(col, F.lit(""))).isin(SEARCH_SEGMENTS)


def path_ids(col: Column) -> Column:
    """``-1,1050,1099`` to an array of ids; segments that are not numbers are skipped."""
    ids = F.transform(F.split(col, ","), lambda s: F.trim(s).try_cast("bigint"))
    return F.filter(ids, lambda i: i.isNotNull())
