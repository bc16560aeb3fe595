"""Registered queries: result description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import describe as DS, rank as R
from findery.operators.terms import term_groups
from findery.workload import tables as T
from findery.workload.extract_queries import encoded_sql, squeeze, words
from findery.workload.registry import register

TITLE_FIELDS = ("missing", "bodytext_en", "urlname")


def _shorten_sql(expr: str, limit: int) -> str:
    head = f"substring(v, 1, {limit + 1})"
    cut = f"length({head}) - instr(reverse({head}), ' ')"
    return f"""(SELECT CASE WHEN length(v) <= {limit} THEN v ELSE regexp_replace(substring(v, 1, CASE WHEN instr({head}, ' ') > 0
      AND {cut} > {limit // 2} THEN {cut} ELSE {limit} END), '[ ,;:-]+$', '') || '...' END FROM (SELECT {expr} AS v))"""


def _page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_hits(T.hits_text(spark, sf_dir)).filter("rank <= 10")


_PAGE = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank
  FROM hits_text) WHERE rank <= 10)"""


@register(
    "resolve_titles",
    f"""SELECT query_id, doc_key, CASE WHEN culture = 'en' THEN {_shorten_sql(squeeze('f_bodytext'), 160)} ELSE name END AS name FROM {_PAGE}""",
)
def resolve_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.resolve_titles(_page(spark, sf_dir), TITLE_FIELDS).select("query_id", "doc_key", "name")


@register("describe_hits", f"SELECT query_id, doc_key, {_shorten_sql(squeeze('f_bodytext'), 320)} AS summary FROM {_PAGE}")
def describe_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.describe_hits(_page(spark, sf_dir)).select("query_id", "doc_key", "summary")


@register(
    "describe_hits_dates",
    """SELECT query_id, doc_key, 'Total ' || n_totalprice AS summary, strftime(day, '%Y-%m-%d %H:%M:%S') AS created, CAST(NULL AS VARCHAR) AS updated
    FROM hits_orders""",
)
def describe_hits_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in four encodings; a summary already there stays."""
    hits = T.hits_orders(spark, sf_dir).withColumns({
        "create_date": F.col("fields")["orderdate"], "summary": F.concat(F.lit("Total "), F.col("fields")["o_totalprice"]),
    })
    rows = DS.describe_hits(hits, ("o_orderstatus",), structured=False)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select("query_id", "doc_key", "summary", stamp("created"), stamp("updated"))


_NESTED = """text || CASE WHEN doc_id % 5 = 0 THEN ' ' || CAST(to_json({'label': 'Home page-square text layout', 'body': text}) AS VARCHAR) ELSE '' END"""


@register(
    "describe_hits_json",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_key, {_shorten_sql("'grid layout of the whole page and more A heading that is long enough to count ' || source || ' ' || " + squeeze(_NESTED), 120)} AS summary FROM documents""",
)
def describe_hits_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs_json(spark, sf_dir)
    return DS.describe_hits(docs, ("nothing", "body"), 120).select("doc_key", "summary")


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words searched per text query: those of its first document's name."""
    first = T.hits_text(spark, sf_dir).groupBy("query_id").agg(F.min_by("name", "node_id").alias("name"))
    letters = F.trim(F.regexp_replace("name", r"[^\p{L}]+", " "))
    return term_groups(first.select("query_id", letters.alias("term")))


_TERMS = r"""(SELECT query_id, '(?i)(' || array_to_string(list_transform(list_distinct(string_split(trim(regexp_replace(name, '[^\p{L}]+', ' ', 'g')), ' ')),
    lambda w: w || '[\p{L}\p{M}\p{N}_]*'), '|') || ')' AS pat
  FROM (SELECT query_id, min_by(name, node_id) AS name FROM hits_text GROUP BY ALL))"""
_SOURCES = f"""(SELECT query_id, doc_key, source, pat, length(string_split_regex(source, pat)[1]) AS pos,
    length(regexp_extract(source, pat, 0)) AS n
  FROM (SELECT p.query_id, p.doc_key, pat, CASE WHEN regexp_matches(f_bodytext, pat) AND {words('f_bodytext')} >= 8 THEN f_bodytext END AS source
        FROM {_PAGE} p JOIN {_TERMS} t ON t.query_id = p.query_id) WHERE source IS NOT NULL)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DS.snippet_source(
        _page(spark, sf_dir), _terms(spark, sf_dir), ("nodename", "bodytext", "bodytext_en"), structured=False
    )


@register("snippet_source", f"SELECT query_id, doc_key, source FROM {_SOURCES}")
def snippet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("query_id", "doc_key", "source")


# The window and the sentence found by looking at one character at a time.
_CHARS = f"""(SELECT *, string_split(source, '') AS c, length(source) AS size FROM {_SOURCES})"""
_BLANK = "(' ', chr(9), chr(10), chr(13), chr(160))"
_WINDOW_TEXT = f"""(SELECT *, CASE WHEN start + full_size >= size OR cut = 0 THEN full_size ELSE cut END AS taken FROM (
  SELECT *, coalesce(list_max(list_filter(range(1, full_size + 1), lambda k: c[start + k] IN {_BLANK})), 0) AS cut FROM (
    SELECT *, least({{length}}, size - start) AS full_size FROM (
      SELECT *, coalesce(list_max(list_filter(range(1, raw + 1), lambda k: c[k] IN {_BLANK})), 0) AS start FROM (
        SELECT *, greatest(0, pos - {{length}} // 3) AS raw FROM {_CHARS})))))"""


def _window(length: int) -> str:
    return _WINDOW_TEXT.replace("{length}", str(length))


def _snippet_sql(spans: str, start: str, size_of: str) -> str:
    piece = rf"regexp_replace(substring(source, {start} + 1, {size_of}), '^\s+|\s+$', '', 'g')"
    return f"""SELECT query_id, doc_key, {piece} AS snippet, {start} > 0 AS cut_before, {start} + {size_of} < size AS cut_after FROM {spans}"""


def _shown(frame: DataFrame) -> DataFrame:
    return frame.select("query_id", "doc_key", "snippet", "cut_before", "cut_after")


@register("snippet_window", _snippet_sql(_window(120), "start", "taken"))
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(DS.snippet_window(_sources(spark, sf_dir), 120))


def _sentences(length: int, context: int) -> str:
    """Sentence spans from the list of sentence ends, widened by ``context`` ends each side."""
    before = f"list_filter(ends, lambda e: e <= pos)"
    after = "list_filter(ends, lambda e: e > pos + n)"
    return f"""(SELECT s.*, CASE WHEN s.length > {max(40, length)} THEN w.start ELSE s.start END AS first,
      CASE WHEN s.length > {max(40, length)} THEN w.taken ELSE s.length END AS total
    FROM (SELECT *, start_raw + length(regexp_extract(substring(source, start_raw + 1), '^\\s*', 0)) AS start,
        greatest(0, stop - start_raw - length(regexp_extract(substring(source, start_raw + 1), '^\\s*', 0))) AS length FROM (
      SELECT *, coalesce(list_reverse(list_sort({before}))[{context + 1}], 0) AS start_raw,
        coalesce(list_sort({after})[{context + 1}], size) AS stop FROM (
        SELECT *, list_filter(range(1, size + 1), lambda e: c[e] IN (chr(10), chr(13)) OR (c[e] IN ('.', '!', '?')
          AND (e = size OR c[e + 1] IN {_BLANK} OR c[e + 1] IN ('"', '''')))) AS ends FROM {_CHARS}))) s
    JOIN {_window(max(40, length))} w ON w.query_id = s.query_id AND w.doc_key = s.doc_key)"""


@register("snippet_sentence", _snippet_sql(_sentences(200, 0), "first", "total"))
def snippet_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(DS.snippet_sentence(_sources(spark, sf_dir), 200))


@register("snippet_sentence_context", _snippet_sql(_sentences(400, 1), "first", "total"))
def snippet_sentence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(DS.snippet_sentence(_sources(spark, sf_dir), 400, 1))


_MARKED = encoded_sql(r"regexp_replace(snippet, pat, chr(57344) || '\0' || chr(57345), 'g')")
STYLE = DS.HighlightStyle(text_colour="Red", background_colour="#FFF", italic=True, font_scale_percent=120, corner_radius=99)


@register(
    "highlight_matches",
    f"""SELECT query_id, doc_key, CASE WHEN cut_before THEN '…' ELSE '' END || replace(replace(
        {_MARKED},
        chr(57344), '<mark style="color:red;background:#fff;font-weight:700;font-style:italic;text-decoration:none;font-size:120%;border-radius:40px">'),
        chr(57345), '</mark>') || CASE WHEN cut_after THEN '…' ELSE '' END AS highlight
    FROM ({_snippet_sql(_window(120), 'start', 'taken').replace('query_id, doc_key,', 'query_id, doc_key, pat,', 1)})""",
)
def highlight_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = DS.snippet_window(_sources(spark, sf_dir), 120)
    return DS.highlight_matches(rows, style=STYLE).select("query_id", "doc_key", "highlight")


@register(
    "type_labels",
    """SELECT query_id, doc_key, CASE type_alias WHEN 'BUILDING' THEN 'Building firm' ELSE type_alias END AS type_label,
      type_alias = 'BUILDING' OR index_type = 'media' OR c_custkey % 10 = 0 AS show_type
    FROM (SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 'media' ELSE index_type END AS index_type) FROM hits_tree)""",
)
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.hits_tree(spark, sf_dir).withColumns({
        "is_best_bet": F.col("doc_key").endswith("0"),
        "index_type": F.when(F.col("doc_key").cast("bigint") % 3 == 0, "Media").otherwise("content"),
    })
    labelled = DS.type_labels(hits, {"building": " Building firm ", "machinery": " "})
    return labelled.select("query_id", "doc_key", "type_label", "show_type")


@register(
    "query_diagnostics",
    """SELECT query_id, count(*) AS fetched, count(*) FILTER (WHERE hidden) AS removed_by_sources,
      count(*) FILTER (WHERE NOT hidden AND culture <> 'en') AS removed_by_facets,
      count(*) FILTER (WHERE NOT hidden AND culture = 'en' AND score < 300) AS removed_by_score,
      count(*) FILTER (WHERE NOT hidden AND culture = 'en' AND score >= 300 AND index_name = 'mirror') AS removed_as_duplicates,
      count(*) FILTER (WHERE NOT hidden AND culture = 'en' AND score >= 300 AND index_name = 'main') AS kept,
      string_agg(DISTINCT index_name, ',' ORDER BY index_name) AS indexes
    FROM (SELECT *, f_hidefromsearch IS NOT NULL AS hidden FROM hits_both) GROUP BY query_id""",
)
def query_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = F.col("fields")["hidefromsearch"].isNull()
    facets = sources & (F.col("culture") == "en")
    score = facets & (F.col("score") >= 300)
    staged = T.hits_both(spark, sf_dir).withColumns({
        "in_sources": sources, "in_facets": facets, "in_score": score,
        "is_kept": score & (F.col("index_name") == "main"),
    })
    return DS.query_diagnostics(staged)
