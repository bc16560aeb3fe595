"""Site pages and request URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from findery.functions import paths as P, text as T

# Query parameters read as the search term, in order.
TERM_PARAMETERS = ["q", "term", "query", "search", "searchterm", "searchtext", "keyword", "keywords"]


def find_search_pages(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct normalised paths of pages that look like a search page.

    ``pages`` has ``path`` (its URL path) and ``type_alias``. A limit, when given, keeps the first
    paths in order.
    """
    path = P.normalize_path(F.col("path"))
    found = pages.filter(
        P.is_search_segment(P.last_segment(path)) | P.is_search_alias(F.col("type_alias"))
    ).select(path.alias("path")).filter("path <> ''").distinct()
    return found if limit is None else found.orderBy("path").limit(limit)


def _pairs(url: Column) -> Column:
    """(lower-cased name, decoded value) of every query parameter, in order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def pair(text: Column) -> Column:
        at = F.instr(text, "=")
        name = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
        value = F.when(at > 0, F.substr(text, at + 1)).otherwise("")
        return F.named_struct(F.lit("name"), F.lower(F.try_url_decode(name)), F.lit("value"), F.try_url_decode(value))

    parts = F.array_remove(F.split(query, "&"), "")
    return F.filter(F.transform(parts, pair), lambda p: p["name"].isNotNull() & p["value"].isNotNull())


def _first(name: Column | str) -> Column:
    return F.get(F.filter("_pairs", lambda p: p["name"] == name), F.lit(0))["value"]


def parse_search_urls(urls: DataFrame, prefix: str = "f_", term_param: str | None = None) -> DataFrame:
    """Adds ``term``, ``page``, ``sort`` and ``filters`` (alias to values) read from ``url``."""
    known = [n.lower() for n in ([term_param] if term_param else []) + TERM_PARAMETERS]
    rows = urls.withColumn("_pairs", _pairs(F.col("url")))
    present = F.transform("_pairs", lambda p: p["name"])
    used = F.get(F.filter(F.array(*[F.lit(n) for n in known]), lambda n: F.array_contains(present, n)), F.lit(0))
    page = F.trim(_first("page")).try_cast("int")
    chosen = F.filter(
        "_pairs",
        lambda p: p["name"].startswith(prefix.lower()) & p["value"].rlike(f"[^{T.SPACE}]"),
    )
    aliases = F.array_distinct(F.transform(chosen, lambda p: F.substr(p["name"], F.lit(len(prefix) + 1))))
    filters = F.map_from_arrays(aliases, F.transform(aliases, lambda a: F.transform(
        F.filter(chosen, lambda p: p["name"] == F.concat(F.lit(prefix.lower()), a)), lambda p: p["value"]
    )))
    rows = rows.withColumn("_used", used)
    return rows.withColumns({
        "term": F.trim(F.coalesce(_first(F.col("_used")), F.lit(""))),
        "page": F.when(page > 0, page).otherwise(1),
        "sort": F.coalesce(_first("sort"), F.lit("")), "filters": filters,
    }).drop("_pairs", "_used")
