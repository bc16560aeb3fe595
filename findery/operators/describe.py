"""What a page's rows say for themselves: titles, summaries, snippets, labels, diagnostics.

These run after the page has been cut, on a handful of rows per query.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from findery.functions import dates as D, fields as X, text as T
from findery.operators.extract import _display_text
from findery.rules import lookup

MAX_TITLE = 160
MIN_SNIPPET_WORDS = 8
MIN_SNIPPET_LENGTH = 40

# Fields a summary is taken from, in order, lower-cased.
DESCRIPTION_FIELDS = [
    "metadescription", "seometadescription", "searchdescription", "description", "summary",
    "excerpt", "teaser", "standfirst", "introtext", "intro", "subtitle", "extractedcontent",
    "bodytext", "content",
]

# Marks from the private use area stand for the tags until the text has been encoded.
_OPEN, _CLOSE = chr(0xE000), chr(0xE001)


def _flattened(values: Column) -> Column:
    """array<string> with JSON values replaced by their readable strings."""

    @F.pandas_udf("array<string>")
    def flatten(rows: pd.Series) -> pd.Series:
        return rows.map(lambda vs: [None if v is None else _display_text(v) for v in vs])

    return flatten(F.transform(values, lambda v: F.when(T.starts_like_json(v), v)))


def _first_text(hits: DataFrame, fields: Sequence[str], limit: int, out: str, structured: bool) -> DataFrame:
    """Adds ``out``: the first field with readable text, shortened."""
    raw = F.array(*[F.coalesce(X.field_value(f), X.variant_value(f)) for f in fields])
    rows = hits.withColumn("_raw", raw)
    if structured:
        rows = rows.withColumn("_flat", _flattened(F.col("_raw"))).withColumn(
            "_raw", F.zip_with("_flat", "_raw", lambda flat, own: F.coalesce(flat, own))
        ).drop("_flat")
    # Only the first readable field is worked out: the fold stops looking once it has one.
    first = F.aggregate(
        "_raw", F.lit(None).cast("string"),
        lambda acc, v: F.when(acc.isNotNull(), acc).otherwise(T.plain_text(v)),
    )
    return rows.withColumn(out, T.shorten(first, limit)).drop("_raw")


def resolve_titles(page_hits: DataFrame, fields: Sequence[str], structured: bool = True) -> DataFrame:
    """The first configured field with text, on one line of at most 160; else the name stays."""
    names = [f.strip() for f in fields if f.strip()]
    if not names:
        return page_hits
    titled = _first_text(page_hits, names, MAX_TITLE, "_title", structured)
    return titled.withColumn("name", F.coalesce("_title", "name")).drop("_title")


def describe_hits(
    page_hits: DataFrame, fields: Sequence[str] = (), limit: int = 320, structured: bool = True
) -> DataFrame:
    """Adds ``summary``, ``created`` and ``updated``; an existing summary is kept."""
    names = [f.strip() for f in fields if f.strip()] or DESCRIPTION_FIELDS
    rows = _first_text(page_hits, names, limit if limit > 0 else 320, "_summary", structured)
    own = F.col("summary") if "summary" in page_hits.columns else F.lit(None).cast("string")
    return rows.withColumns({
        "summary": F.coalesce(own, "_summary"),
        "created": D.parse_date(F.coalesce(X.stored(X.CREATE_DATE), F.col("create_date"))),
        "updated": D.parse_date(F.coalesce(X.stored(X.UPDATE_DATE), F.col("update_date"))),
    }).drop("_summary")


def word_patterns(query_terms: DataFrame) -> DataFrame:
    """(query_id, pattern): any searched word, with any tail, ignoring case."""
    words = F.transform(
        F.array_sort(F.collect_list(F.struct("group_no", "variant_no", "variant"))), lambda s: s["variant"]
    )
    quoted = F.transform(
        F.array_remove(F.array_distinct(words), ""),
        lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E\\w*")),
    )
    pattern = F.concat(F.lit("(?iuU)(?:"), F.array_join(quoted, "|"), F.lit(")"))
    rows = query_terms.groupBy("query_id").agg(F.size(quoted).alias("_n"), pattern.alias("pattern"))
    return rows.filter("_n > 0").drop("_n")


def snippet_source(
    page_hits: DataFrame, query_terms: DataFrame, searched_fields: Sequence[str],
    field: str | None = None, structured: bool = True,
) -> DataFrame:
    """Adds ``source`` (the text a snippet is cut from) and ``pattern``; rows without one go.

    The named field; else extracted content that holds a word; else the longest searched field
    that does. A text needs eight words to be read at all.
    """
    rows = page_hits.join(word_patterns(query_terms), "query_id")
    if field and field.strip():
        candidates = [X.field_value(field.strip())]
    else:
        extracted = F.coalesce(X.stored(X.EXTRACTED), X.variant_value(X.EXTRACTED))
        candidates = [extracted, *[X.field_value(f) for f in dict.fromkeys(f.lower() for f in searched_fields)]]
    rows = rows.withColumn("_texts", F.array(*candidates))
    if structured:
        rows = rows.withColumn("_flat", _flattened(F.col("_texts"))).withColumn(
            "_texts", F.zip_with("_flat", "_texts", lambda flat, own: F.coalesce(flat, own))
        ).drop("_flat")
    if field and field.strip():
        source = F.get(F.col("_texts"), F.lit(0))
    else:
        pattern = F.col("pattern")
        usable = F.filter(
            F.transform("_texts", lambda t, i: F.named_struct(
                F.lit("first"), (i == 0), F.lit("size"), F.length(t), F.lit("place"), -i, F.lit("text"), t
            )),
            lambda c: c["text"].isNotNull() & F.regexp_like(c["text"], pattern)
            & (T.word_count(c["text"]) >= MIN_SNIPPET_WORDS),
        )
        source = F.array_max(usable)["text"]
    return rows.withColumn("source", source).drop("_texts").filter("source IS NOT NULL AND trim(source) <> ''")


_SPACE_CLASS = f"[{T.SPACE}]"
_NOT_SPACE = f"[^{T.SPACE}]"
# A sentence ends at a line break, or at . ! ? before white space or a quote.
_TO_LAST_END = rf"(?s)^(.*(?:[\n\r](?=.)|[.!?](?=[{T.SPACE}\"'])))"
_TO_NEXT_END = rf"(?s)^(.*?(?:[\n\r]|[.!?](?=[{T.SPACE}\"']|\z)))"


def _from(text: Column, start: Column) -> Column:
    return F.substr(text, start + 1)


def _upto(text: Column, end: Column) -> Column:
    return F.substr(text, F.lit(1), end)


def _window_span(source: Column, at: Column, length: int) -> Column:
    """struct(start, size): ``length`` characters from a third before the match, at word edges."""
    length = max(MIN_SNIPPET_LENGTH, length)
    raw_start = F.greatest(F.lit(0), at - length // 3)
    back = F.length(F.regexp_extract(_upto(source, raw_start), rf"({_NOT_SPACE}*)\z", 1))

    def sized(start: Column) -> Column:
        full = F.least(F.lit(length), F.length(source) - start)
        piece = F.substr(source, start + 1, full)
        whole_words = F.length(F.regexp_replace(piece, rf"{_NOT_SPACE}+\z", ""))
        ends = start + full >= F.length(source)
        size = F.when(ends | (whole_words == 0), full).otherwise(whole_words)
        return F.named_struct(F.lit("start"), start, F.lit("size"), size)

    return T.let(raw_start - back, sized)


def _sentence_span(source: Column, at: Column, match_size: Column, length: int, context: int) -> Column:
    """struct(start, size): the sentence of the match and ``context`` neighbours on each side."""
    def before(start: Column) -> Column:
        return F.length(F.regexp_extract(_upto(source, start), _TO_LAST_END, 1))

    def after(end: Column) -> Column:
        rest = _from(source, end)
        found = F.length(F.regexp_extract(rest, _TO_NEXT_END, 1))
        return end + F.when(found > 0, found).otherwise(F.length(rest))

    # The match's own first character is the look-ahead of the end before it.
    start, end = before(at + 1), after(at + match_size)
    for _ in range(context):
        start, end = T.let(start, before), T.let(end, after)

    def trimmed(s: Column, e: Column) -> Column:
        lead = F.length(F.regexp_extract(_from(source, s), f"^({_SPACE_CLASS}*)", 1))
        size = F.greatest(F.lit(0), F.least(e - (s + lead), F.length(source) - (s + lead)))
        return F.named_struct(F.lit("start"), s + lead, F.lit("size"), size)

    span = T.let(start, lambda s: T.let(end, lambda e: trimmed(s, e)))
    ceiling = max(MIN_SNIPPET_LENGTH, length)
    return T.let(span, lambda p: F.when(p["size"] > ceiling, _window_span(source, at, length)).otherwise(p))


def _snippets(sources: DataFrame, span_of) -> DataFrame:
    source, pattern = F.col("source"), F.col("pattern")
    found = F.regexp_substr(source, pattern)
    rows = sources.withColumn("_size", F.coalesce(F.length(found), F.lit(0))).withColumn(
        "_at", F.when(F.col("_size") > 0, F.instr(source, F.regexp_substr(source, pattern)) - 1).otherwise(0)
    )
    rows = rows.withColumn("_span", span_of(source, F.col("_at"), F.col("_size")))
    start, size = F.col("_span.start"), F.col("_span.size")
    piece = F.regexp_replace(F.substr(source, start + 1, size), f"^{_SPACE_CLASS}+|{_SPACE_CLASS}+$", "")
    return rows.withColumns({
        "snippet": piece, "cut_before": start > 0, "cut_after": start + size < F.length(source),
    }).drop("_span", "_at", "_size")


def snippet_sentence(sources: DataFrame, length: int = 200, context: int = 0) -> DataFrame:
    """Adds ``snippet``, ``cut_before`` and ``cut_after``: the sentence around the first match."""
    return _snippets(sources, lambda s, at, n: _sentence_span(s, at, n, length, context))


def snippet_window(sources: DataFrame, length: int = 200) -> DataFrame:
    """The same from a plain character window around the first match."""
    return _snippets(sources, lambda s, at, n: _window_span(s, at, length))


@dataclass(frozen=True)
class HighlightStyle:
    text_colour: str = "#15803d"
    background_colour: str = ""
    bold: bool = True
    italic: bool = False
    underline: bool = False
    font_scale_percent: int = 100
    corner_radius: int = 0
    padding_x: int = 0
    padding_y: int = 0


def css_colour(value: str) -> str | None:
    """A hex colour of 3, 6 or 8 digits, or a plain colour word; anything else is refused."""
    text = value.strip().lower()
    if text.startswith("#"):
        digits = text[1:]
        return text if len(digits) in (3, 6, 8) and all(c in "0123456789abcdef" for c in digits) else None
    return text if text.isascii() and text.isalpha() and len(text) <= 24 else None


def mark_tag(style: HighlightStyle) -> str:
    """The opening tag a style stands for; its numbers are clamped."""
    def clamp(value: int, low: int, high: int) -> int:
        return min(max(value, low), high)

    scale = clamp(style.font_scale_percent if style.font_scale_percent > 0 else 100, 50, 300)
    radius = clamp(style.corner_radius, 0, 40)
    pad_x, pad_y = clamp(style.padding_x, 0, 40), clamp(style.padding_y, 0, 40)
    colour = css_colour(style.text_colour)
    parts = {
        "color": colour, "background": css_colour(style.background_colour) or "transparent",
        "font-weight": "700" if style.bold else "inherit", "font-style": "italic" if style.italic else None,
        "text-decoration": "underline" if style.underline else "none",
        "font-size": f"{scale}%" if scale != 100 else None,
        "border-radius": f"{radius}px" if radius else None,
        "padding": f"{pad_y}px {pad_x}px" if pad_x or pad_y else None,
    }
    return '<mark style="' + ";".join(f"{k}:{v}" for k, v in parts.items() if v) + '">'


def highlight_matches(
    snippets: DataFrame, start_tag: str = "<mark>", end_tag: str = "</mark>", style: HighlightStyle | None = None
) -> DataFrame:
    """Adds ``highlight``: the snippet encoded, its matches tagged, cut ends marked.

    Matches are marked before encoding, so a search for ``amp`` cannot hit ``&amp;``.
    """
    opening = mark_tag(style) if style else start_tag
    closing = "</mark>" if style else end_tag
    marked = F.col("snippet")
    if opening:
        marked = F.regexp_replace(marked, F.col("pattern"), F.lit(_OPEN + "$0" + _CLOSE))
    encoded = T.html_encode(marked)
    tagged = F.replace(F.replace(encoded, F.lit(_OPEN), F.lit(opening)), F.lit(_CLOSE), F.lit(closing))
    cut = lambda flag: F.when(flag, "…").otherwise("")
    return snippets.withColumn("highlight", F.concat(cut(F.col("cut_before")), tagged, cut(F.col("cut_after"))))


def type_labels(
    hits: DataFrame, labels: dict[str, str], show_on_content: bool = False, hidden: bool = False
) -> DataFrame:
    """Adds ``type_label`` and ``show_type``."""
    worded = {k: v.strip() for k, v in labels.items() if v.strip()}
    key = F.coalesce(F.nullif(F.trim("type_alias"), F.lit("")), F.trim("index_type"), F.lit(""))
    label = lookup(key, worded, "string")
    shown = (
        F.col("is_best_bet") | F.lit(show_on_content) | label.isNotNull()
        | (F.lower("index_type") != "content")
    )
    return hits.withColumns({
        "type_label": F.coalesce(label, key), "show_type": F.lit(not hidden) & shown,
    })


def query_diagnostics(staged_hits: DataFrame) -> DataFrame:
    """Per query: rows at each stage and how many each stage removed.

    ``staged_hits`` holds every fetched row once, with flags ``in_sources``, ``in_facets``,
    ``in_score`` and ``is_kept``; each flag implies the ones before it.
    """
    def count(flag: Column) -> Column:
        return F.sum(F.when(flag, 1).otherwise(0))

    sources, facets, score, kept = (F.col(c) for c in ("in_sources", "in_facets", "in_score", "is_kept"))
    return staged_hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("fetched"), count(~sources).alias("removed_by_sources"),
        count(sources & ~facets).alias("removed_by_facets"), count(facets & ~score).alias("removed_by_score"),
        count(score & ~kept).alias("removed_as_duplicates"), count(kept).alias("kept"),
        F.array_join(F.array_sort(F.collect_set("index_name")), ",").alias("indexes"),
    )
