"""Body text out of indexed fields.

A document's fields are worked on inside its row, with array functions, so extraction needs no
shuffle at all. Only values that start like JSON are sent to Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from findery.functions import fields as X, text as T

DEFAULT_MIN_WORDS = 6
DEFAULT_MAX_DEPTH = 12
PASSES = "array<struct<culture:string,text:string>>"

# Keys whose whole subtree is structure, and keys whose own text is a label.
SKIP_SUBTREE_KEYS = [
    "layout", "settingsData", "settings", "editor", "config", "styles", "view", "appearance",
]
SKIP_VALUE_KEYS = [
    "contentTypeKey", "contentTypeAlias", "contentTypeName", "udi", "key", "id", "$type", "alias",
    "columnSpan", "rowSpan", "areaGridColumns", "gridColumns", "identifier", "rowKey",
    "settingsKey", "contentKey", "name", "label", "icon", "sortOrder", "level", "path", "nodeType",
    "writerName", "creatorName", "template", "culture", "segment", "expanded", "disabled", "grid",
    "cols", "colSpan", "title", "heading", "subheading", "headline", "subtitle",
]
# Keys left out of the laxer display flattening.
DISPLAY_NOISE_KEYS = ["contentTypeKey", "key", "udi", "settingsKey", "settingsUdi", "icon", "culture"]

# Field names never read for body text, lower-cased.
EXCLUDED_FIELDS = [
    "id", "__nodeid", "__key", "__indextype", "__nodetypealias", "__path", "__icon", "__published",
    "__variesbyculture", "__raw_", "nodetype", "templateid", "icon", "creatorid", "creatorname",
    "writerid", "writername", "level", "parentid", "sortorder", "path", "createdate", "updatedate",
    "published", "trashed", "urlname", "umbraconavihide", "loginname", "umbracofile",
    "umbracofilesrc", "umbracoextension", "umbracobytes", "umbracowidth", "umbracoheight",
    "umbracoredirect", "umbracourlalias", "umbracourlname", "nodename", "pagetitle", "title",
    "heading", "subheading", "headline", "subtitle", "pageheading", "bannertitle", "bannerheading",
    "metatitle", "seotitle", "browsertitle", "linktitle", "navigationtitle", "navtitle",
    "shorttitle", "cardtitle", "listingtitle",
]
CULTURE_SUFFIX = r"^.+_([A-Za-z]{2,3}(?:-(?:[A-Za-z]{2}|[A-Za-z]{4}))?)$"

# Fields a source text is assembled from, in order, lower-cased.
PREFERRED_BODY_FIELDS = [
    "bodytext", "content", "maincontent", "description", "metadescription", "summary",
    "introduction", "intro", "abstract", "text",
]


def culture_of(field: Column) -> Column:
    """The culture a field name ends in, lower-cased; empty for an invariant field."""
    return F.lower(F.regexp_extract(field, CULTURE_SUFFIX, 1))


def is_candidate(field: Column, culture: Column) -> Column:
    """Whether a field is read for a culture; a null culture takes invariant fields only."""
    name = F.lower(F.trim(field))
    suffix = culture_of(name)
    base = F.when(suffix == "", name).otherwise(
        F.substr(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    )
    excluded = name.isin(EXCLUDED_FIELDS) | base.isin(EXCLUDED_FIELDS)
    wanted = (suffix == "") | F.coalesce(suffix == F.lower(culture), F.lit(False))
    return (name != "") & ~name.startswith("__") & ~excluded & wanted


def candidate_fields(long_docs: DataFrame, culture: str | None) -> DataFrame:
    return long_docs.filter(is_candidate(F.col("field"), F.lit(culture).cast("string")))


def culture_suffixes(long_docs: DataFrame) -> DataFrame:
    """Every culture a document has fields for, plus the invariant (null) pass."""
    found = long_docs.groupBy("index_name", "doc_key").agg(
        F.collect_set(F.nullif(culture_of(F.col("field")), F.lit(""))).alias("cultures")
    )
    return found.select("index_name", "doc_key", F.explode(_with_invariant(F.col("cultures"))).alias("culture"))


def _with_invariant(cultures: Column) -> Column:
    return F.concat(F.array(F.lit(None).cast("string")), cultures)


def clean_text(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, T.clean_text(F.col(col)))


def word_count_filter(df: DataFrame, col: str, min_words: int = DEFAULT_MIN_WORDS) -> DataFrame:
    return df.filter(T.word_count(F.col(col)) >= min(max(min_words, 1), 100))


def machine_values(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("is_machine_value", T.is_machine_value(F.col(col)))


def structured_flag(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({
        "looks_structured": T.looks_structured(F.col(col)),
        "is_leftover": T.structured_leftover(F.col(col)),
    })


def _strings(node: object, key: str | None, depth: int, max_depth: int, skip: frozenset[str]) -> Iterator[tuple]:
    """(key, text) of every string in document order, subtrees under ``skip`` left out."""
    if depth > max_depth:
        return
    if isinstance(node, str):
        yield key, node
    elif isinstance(node, dict):
        for name, child in node.items():
            if name.lower() not in skip:
                yield from _strings(child, name.lower(), depth + 1, max_depth, skip)
    elif isinstance(node, list):
        for child in node:
            yield from _strings(child, key, depth + 1, max_depth, skip)


def _parse(text: str) -> object | None:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


_PROSE_SKIP = frozenset(k.lower() for k in SKIP_SUBTREE_KEYS)
_LABELS = frozenset(k.lower() for k in SKIP_VALUE_KEYS)
_NOISE = frozenset(k.lower() for k in DISPLAY_NOISE_KEYS)


def _prose_candidates(text: str, max_depth: int) -> list[str] | None:
    """Unlabelled strings of a JSON text, nested JSON strings opened; null when it is no JSON."""
    root = _parse(text)
    if root is None:
        return None
    out: list[str] = []
    for key, value in _strings(root, None, 0, max_depth, _PROSE_SKIP):
        if key in _LABELS:
            continue
        nested = _prose_candidates(value, max_depth) if value.lstrip()[:1] in ("{", "[") else None
        out += [value] if nested is None else nested
    return out


def _json_strings(col: Column, max_depth: int) -> Column:
    """array<string> of candidate strings; null where the value is not JSON."""

    @F.pandas_udf("array<string>")
    def walk(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _prose_candidates(v, max_depth))

    return walk(F.when(T.starts_like_json(col), col))


def _kept(texts: Column, min_words: int) -> Column:
    """Candidate strings cleaned; identifiers and short ones dropped."""
    language = F.filter(texts, lambda t: ~T.is_machine_value(t))
    cleaned = F.transform(language, T.clean_text)
    return F.filter(cleaned, lambda t: T.word_count(t) >= min_words)


def extract_json_text(
    df: DataFrame, col: str, min_words: int = DEFAULT_MIN_WORDS, max_depth: int = DEFAULT_MAX_DEPTH
) -> DataFrame:
    """Adds ``texts``: the prose strings of a JSON value, or the value itself when it is prose."""
    prose = F.array(T.clean_text(F.col(col)))
    walked = df.withColumn("_strings", _json_strings(F.col(col), max_depth))
    texts = F.when(F.col("_strings").isNotNull(), _kept(F.col("_strings"), min_words)).otherwise(
        F.filter(prose, lambda t: T.word_count(t) >= min_words)
    )
    return walked.withColumn("texts", F.coalesce(texts, F.array().cast("array<string>"))).drop("_strings")


def _display_text(text: str) -> str:
    """Readable strings of a JSON text joined by spaces; the text itself when there are none."""
    root = _parse(text)
    if root is None:
        return text
    found = (v for _, v in _strings(root, None, 0, 1_000, _NOISE))
    flat = " ".join(v for v in found if v.strip() and v.strip().lower() not in _NOISE)
    return flat.strip() or text


def flatten_structured(df: DataFrame, col: str) -> DataFrame:
    """Laxer flattening for display: tags out of JSON strings, no word minimum."""

    @F.pandas_udf("string")
    def flatten(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _display_text(v))

    is_json = T.starts_like_json(F.col(col))
    flat = df.withColumn("_flat", flatten(F.when(is_json, F.col(col))))
    bare = F.trim(F.regexp_replace("_flat", "<[^>]+>", " "))
    return flat.withColumn(
        col, F.when(is_json & (F.col("_flat") != F.col(col)), bare).otherwise(F.col(col))
    ).drop("_flat")


def _first_uses(texts: Column, max_chars: int | None) -> Column:
    """Texts joined by a space: repeats dropped ignoring case, none started past the limit."""
    # In lower case and then in order, the first of equal texts stands behind a different one; then they go back to their places.
    marked = F.sort_array(F.transform(texts, lambda t, i: F.struct(F.lower(t).alias("low"), i.alias("at"), t.alias("text"))))
    once = T.let(marked, lambda m: F.filter(m, lambda e, i: (i == 0) | (F.get(m, i - 1)["low"] != e["low"])))
    places = F.sort_array(F.transform(once, lambda e: F.struct(e["at"].alias("at"), e["text"].alias("text"))))
    first = F.transform(places, lambda e: e["text"])
    if max_chars is None:
        return F.array_join(first, " ")
    empty = F.struct(
        F.lit(0).alias("length"), F.array().cast("array<string>").alias("kept"),
    )

    def step(acc: Column, text: Column) -> Column:
        grown = F.named_struct(
            F.lit("length"), acc["length"] + F.length(text) + 1,
            F.lit("kept"), F.concat(acc["kept"], F.array(text)),
        )
        return F.when(acc["length"] < max_chars, grown).otherwise(acc)

    joined = F.aggregate(first, empty, step, lambda acc: F.array_join(acc["kept"], " "))
    return F.when(F.length(joined) <= max_chars, joined).otherwise(
        F.rtrim(F.substring(joined, 1, max_chars))
    )


def extracted_content(
    docs: DataFrame,
    min_words: int = DEFAULT_MIN_WORDS,
    max_chars: int | None = None,
    structured: bool = True,
    max_depth: int = DEFAULT_MAX_DEPTH,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per document culture with its body text; empty ones are omitted.

    Texts are whole unless ``max_chars`` is given. Fields are read in name order; equal values of a document are cleaned once. ``structured=False``
    states that no field holds JSON and keeps the whole job inside the JVM. With ``keep_empty`` a document without any text
    stays, with a null culture and text.
    """
    min_words = max(min_words, 1)
    entries = F.array_sort(F.map_entries("fields"))
    # Only fields some culture may read are cleaned, once for all cultures.
    readable = F.filter(entries, lambda e: is_candidate(e["key"], culture_of(e["key"])))
    rows = docs.select("index_name", "doc_key", readable.alias("entries"))
    if structured:

        @F.pandas_udf("array<array<string>>")
        def walk(values: pd.Series) -> pd.Series:
            return values.map(lambda vs: None if vs is None else [
                None if v is None else _prose_candidates(v, max_depth) for v in vs
            ])

        masked = F.transform("entries", lambda e: F.when(T.starts_like_json(e["value"]), e["value"]))
        rows = rows.withColumn("json", walk(masked))

    values = F.array_distinct(F.transform("entries", lambda e: e["value"]))
    prose = F.transform(values, lambda v: F.filter(F.array(T.clean_text(v)), lambda t: T.has_words(t, min_words)))

    def read(cleaned: Column, entry: Column, i: Column) -> Column:
        texts = F.element_at(cleaned, F.array_position(values, entry["value"]).cast("int"))
        if structured:
            found = F.get(F.col("json"), i)
            texts = F.when(found.isNotNull(), _kept(found, min_words)).otherwise(texts)
        return F.named_struct(F.lit("of"), culture_of(entry["key"]), F.lit("texts"), texts)

    def passes(read_values: Column) -> Column:
        """A text for each culture and the invariant pass."""
        cultures = F.array_distinct(F.filter(F.transform("entries", lambda e: culture_of(e["key"])), lambda c: c != ""))

        def text(culture: Column) -> Column:
            own = F.filter(read_values, lambda v: (v["of"] == "") | (v["of"] == culture))
            texts = F.flatten(F.transform(own, lambda v: v["texts"]))
            return F.named_struct(F.lit("culture"), culture, F.lit("text"), _first_uses(texts, max_chars))

        return F.filter(F.transform(_with_invariant(cultures), text), lambda p: p["text"] != "")

    found = T.let(T.let(prose, lambda cleaned: F.transform("entries", lambda e, i: read(cleaned, e, i))), passes)
    if keep_empty:
        none = F.array(F.named_struct(F.lit("culture"), F.lit(None).cast("string"), F.lit("text"), F.lit(None).cast("string")))
        found = T.let(found, lambda f: F.when(F.size(F.coalesce(f, F.array().cast(PASSES))) > 0, f).otherwise(none))
    return rows.select("index_name", "doc_key", F.inline(found))


def assemble_source_text(docs: DataFrame, max_chars: int) -> DataFrame:
    """Per document, its preferred fields and then its long other ones, within a budget."""
    budget = max(200, max_chars)
    preferred = [X.stored(f) for f in PREFERRED_BODY_FIELDS]
    others = F.filter(
        F.array_sort(F.map_entries("fields")),
        lambda e: ~e["key"].startswith("__")
        & ~e["key"].isin(X.METADATA_FIELDS + PREFERRED_BODY_FIELDS)
        & (F.length(e["value"]) >= 80),
    )
    raw = F.concat(F.array(*preferred), F.transform(others, lambda e: e["value"]))
    cleaned = F.filter(
        F.transform(F.filter(raw, lambda v: v.isNotNull()), T.clean_text), lambda t: t != ""
    )
    start = F.struct(F.lit(0).alias("length"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, text: Column) -> Column:
        part = F.substr(text, F.lit(1), F.lit(budget) - acc["length"])
        grown = F.named_struct(
            F.lit("length"), acc["length"] + F.length(part),
            F.lit("parts"), F.concat(acc["parts"], F.array(part)),
        )
        return F.when(acc["length"] < budget, grown).otherwise(acc)

    body = F.aggregate("cleaned", start, step, lambda acc: F.array_join(acc["parts"], "\n\n"))
    name = F.coalesce(X.stored(X.NODE_NAME), X.stored(X.SYSTEM_NODE_NAME), F.col("name"))
    return docs.select("index_name", "doc_key", T.clean_text(name).alias("title"), cleaned.alias("cleaned")).select(
        "index_name", "doc_key", "title", body.alias("body")
    )


def source_blocks(hits: DataFrame, texts: DataFrame, k: int = 4) -> DataFrame:
    """Per query, its top ``k`` hits as numbered, fenced blocks in one string."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_key", "index_name")
    top = (
        hits.select("query_id", "index_name", "doc_key", "score")
        .withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    )
    blocks = top.join(texts, ["index_name", "doc_key"]).withColumn(
        "block",
        F.concat(
            F.lit('<source n="'), F.col("n").cast("string"), F.lit('" title="'),
            T.fence(F.col("title")), F.lit('">\n'), T.fence(F.col("body")), F.lit("\n</source>\n\n"),
        ),
    )
    ordered = F.array_sort(F.collect_list(F.struct("n", "block")))
    return blocks.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "").alias("blocks")
    )
