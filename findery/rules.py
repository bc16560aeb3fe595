"""The rule set: small values written by an editor, compiled into column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F



@dataclass(frozen=True)
class FieldRule:
    name: str
    boost: float = 1.0
    match_mode: str = "prefix"  # exact, prefix, wildcard, fuzzy
    enabled: bool = True


@dataclass(frozen=True)
class FacetRange:
    alias: str
    label: str = ""
    from_bound: str = ""
    to_bound: str = ""


@dataclass(frozen=True)
class Facet:
    alias: str
    field: str = ""
    label: str = ""
    kind: str = "field"  # field, dateRange, numeric
    ranges: tuple[FacetRange, ...] = ()
    max_values: int = 20
    hide_empty: bool = True
    enabled: bool = True
    requires: tuple[str, ...] = ()

    @property
    def target(self) -> str:
        return self.field.strip() or self.alias


@dataclass(frozen=True)
class SortRule:
    field: str
    direction: str = "ascending"


@dataclass(frozen=True)
class SortOption:
    alias: str
    label: str
    field: str = ""
    direction: str = "ascending"
    enabled: bool = True


@dataclass(frozen=True)
class BestBet:
    terms: tuple[str, ...]
    node_keys: tuple[str, ...]


@dataclass(frozen=True)
class Recency:
    field: str
    half_life_days: int = 90
    weight: float = 0.5


@dataclass(frozen=True)
class Highlight:
    """How a result's snippet is cut and marked; ``mode`` is sentence or window."""

    mode: str = "sentence"
    field: str = ""
    length: int = 200
    context: int = 0
    mark: bool = True
    start_tag: str = "<mark>"
    end_tag: str = "</mark>"


@dataclass(frozen=True)
class RuleSet:
    # matching
    fields: tuple[FieldRule, ...] = ()
    operator: str = "or"
    all_terms: bool = False
    fuzziness: float = 0.8
    minimum_length: int = 2
    minimum_score: float = 0.0
    stop_words: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, str], ...] = ()
    blocked_terms: tuple[str, ...] = ()
    # sources
    index_names: tuple[str, ...] = ()
    include_content_types: tuple[str, ...] = ()
    include_media_types: tuple[str, ...] = ()
    include_members: bool = False
    exclude_types: tuple[str, ...] = ()
    cultures: tuple[str, ...] = ()
    root_ids: tuple[int, ...] = ()
    excluded_ids: tuple[int, ...] = ()
    exclude_descendants: bool = True
    respect_navi_hide: bool = True
    hide_fields: tuple[str, ...] = ()
    published_only: bool = True
    # ranking
    type_boosts: tuple[tuple[str, float], ...] = ()
    recency: Recency | None = None
    best_bets: tuple[BestBet, ...] = ()
    sort_by: tuple[SortRule, ...] = ()
    # results
    deduplicate: bool = True
    dedup_field: str = ""
    facets: tuple[Facet, ...] = ()
    sort_options: tuple[SortOption, ...] = ()
    minimum_active_filters: int = 0
    page_size: int = 10
    browse_page_size: int = 10
    max_results: int | None = None
    return_fields: tuple[str, ...] = ()
    title_fields: tuple[str, ...] = ()
    description_fields: tuple[str, ...] = ()
    description_length: int = 320
    highlight: Highlight | None = None
    type_labels: tuple[tuple[str, str], ...] = ()
    group_by_type: bool = False
    curated: tuple[str, ...] = ()
    rerank_depth: int = 0

    @property
    def window(self) -> int | None:
        """How many of the best rows of a query and index are fetched; none set, all are."""
        return self.max_results if self.max_results and self.max_results > 0 else None

    def with_(self, **changes: Any) -> RuleSet:
        return replace(self, **changes)


def rule_frame(rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Rule texts as a frame held in the plan; its size is known, so Spark chooses the join."""
    table = pa.table({c: pa.array([row[i] for row in rows], pa.string()) for i, c in enumerate(columns)})
    return SparkSession.active().createDataFrame(table)


def text_array(values: Sequence[str], lower: bool = True) -> Column:
    """Rule words as an array literal, trimmed and lower-cased, blanks dropped."""
    words = [v.strip().lower() if lower else v.strip() for v in values if v and v.strip()]
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def lookup(col: Column, pairs: dict[str, Any], sql_type: str) -> Column:
    """The rule value for a lower-cased key, null without one."""
    if not pairs:
        return F.lit(None).cast(sql_type)
    parts = [F.lit(x) for key, value in pairs.items() for x in (key.strip().lower(), value)]
    return F.try_element_at(F.create_map(*parts), F.lower(col)).cast(sql_type)
