"""Registered queries: content extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import extract as E
from findery.workload import tables as T
from findery.workload.registry import register

_WS = r"[\s\x{0b}\x{85}\x{a0}\x{2028}\x{2029}\x{2000}-\x{200a}\x{3000}]+"


def numbered_sql(expr: str) -> str:
    """The characters from U+00A0 to U+00FF as numbers."""
    for code in range(0xA0, 0x100):
        expr = f"replace({expr}, chr({code}), '&#{code};')"
    return expr


def encoded_sql(expr: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        expr = f"replace({expr}, '{char}', '{entity}')"
    return numbered_sql(expr)


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{_WS}', ' ', 'g'))"


def clean(expr: str) -> str:
    """SQL twin of text cleaning, for the entities that occur in the given pages."""
    out = squeeze(f"regexp_replace({expr}, '<[^>]*>?|>', ' ', 'g')")
    for entity, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
        ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"),
    ):
        out = f"replace({out}, '{entity}', '{char}')"
    return squeeze(out)


def words(expr: str) -> str:
    return f"len(list_filter(string_split({squeeze(expr)}, ' '), lambda w: w <> ''))"


_TEXT_LONG = """
SELECT index_name, doc_key, 'bodytext' AS field, f_bodytext AS value FROM docs_text
UNION ALL SELECT index_name, doc_key, 'bodytext_' || culture, f_bodytext FROM docs_text
UNION ALL SELECT index_name, doc_key, 'n_chars', f_n_chars FROM docs_text
UNION ALL SELECT index_name, doc_key, '__published', f_published FROM docs_text WHERE f_published IS NOT NULL
UNION ALL SELECT index_name, doc_key, 'hidefromsearch', f_hidefromsearch FROM docs_text
  WHERE f_hidefromsearch IS NOT NULL
"""


@register(
    "candidate_fields",
    f"""SELECT doc_key, field, length(value) AS size FROM ({_TEXT_LONG})
    WHERE field IN ('bodytext', 'bodytext_fr', 'n_chars', 'hidefromsearch')""",
)
def candidate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.candidate_fields(T.long_docs(T.docs_text(spark, sf_dir)), "fr")
    return rows.select("doc_key", "field", F.length("value").cast("bigint").alias("size"))


@register(
    "culture_suffixes",
    """SELECT doc_key, culture FROM docs_text UNION ALL SELECT doc_key, NULL FROM docs_text""",
)
def culture_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.culture_suffixes(T.long_docs(T.docs_text(spark, sf_dir))).select("doc_key", "culture")


@register("clean_text", f"SELECT page_id, {clean('html')} AS html FROM pages")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.clean_text(T.table(spark, sf_dir, "pages").select("page_id", "html"), "html")


@register(
    "word_count_filter",
    f"SELECT conv_id, turn, text FROM conversations WHERE {words('text')} >= 12",
)
def word_count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return E.word_count_filter(turns, "text", 12)


_VALUES = """
SELECT doc_id || '-' || 'text' AS id, text AS value FROM documents
UNION ALL SELECT doc_id || '-' || 'source', source FROM documents
UNION ALL SELECT page_id || '-' || 'url', url FROM pages
UNION ALL SELECT page_id || '-' || 'umb', ' umb://document/' || page_id || ' x' FROM pages
UNION ALL SELECT page_id || '-' || 'json', ' {"contentTypeKey": "' || page_id || '"}' FROM pages
UNION ALL SELECT page_id || '-' || 'guid', regexp_replace(md5(CAST(page_id AS VARCHAR)),
  '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') FROM pages
"""


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = T.table(spark, sf_dir, "documents"), T.table(spark, sf_dir, "pages")
    page = F.col("page_id").cast("string")
    guid = F.regexp_replace(F.md5(page), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    parts = [
        docs.select(F.concat("doc_id", F.lit("-text")).alias("id"), F.col("text").alias("value")),
        docs.select(F.concat("doc_id", F.lit("-source")), "source"),
        pages.select(F.concat("page_id", F.lit("-url")), "url"),
        pages.select(F.concat("page_id", F.lit("-umb")), F.concat(F.lit(" umb://document/"), page, F.lit(" x"))),
        pages.select(F.concat("page_id", F.lit("-json")), F.concat(F.lit(' {"contentTypeKey": "'), page, F.lit('"}'))),
        pages.select(F.concat("page_id", F.lit("-guid")), guid),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@register(
    "machine_values",
    f"""SELECT id, NOT regexp_matches(trim(value), '\\s') OR regexp_matches(trim(value), '^(?i)(umb|https?)://')
      AS is_machine_value FROM ({_VALUES})""",
)
def machine_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.machine_values(_values(spark, sf_dir), "value").select("id", "is_machine_value")


@register(
    "structured_flag",
    f"""SELECT id, (value LIKE ' {{%' OR value LIKE '%":%' OR value ILIKE '%contentTypeKey%'
        OR value ILIKE '%umb://%') AS looks_structured,
      (value LIKE '%":%' OR value ILIKE '%umb://%' OR {words('value')} < 2) AS is_leftover
    FROM ({_VALUES})""",
)
def structured_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = E.structured_flag(_values(spark, sf_dir), "value")
    return flags.select("id", "looks_structured", "is_leftover")


@register(
    "extracted_content",
    f"""WITH p AS (SELECT doc_key, culture, {clean('f_html')} AS t, f_url, {clean('f_url')} AS u FROM docs_pages)
    SELECT doc_key, t AS text FROM p WHERE {words('t')} >= 6""",
)
def extracted_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.extracted_content(T.docs_pages(spark, sf_dir), structured=False)
    return rows.select("doc_key", "text")


@register(
    "extracted_content_cultures",
    f"""WITH t AS (SELECT doc_key, culture, {clean('f_bodytext')} AS t FROM docs_text)
    SELECT doc_key, CAST(NULL AS VARCHAR) AS culture, t AS text FROM t WHERE {words('t')} >= 6
    UNION ALL SELECT doc_key, culture, t FROM t WHERE {words('t')} >= 6""",
)
def extracted_content_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain and the culture field hold the same text, so it is written once per culture."""
    rows = E.extracted_content(T.docs_text(spark, sf_dir), structured=False)
    return rows.select("doc_key", "culture", "text")


_JSON_TEXTS = f"""
SELECT CAST(doc_id AS VARCHAR) AS doc_key,
  array_to_string(list_filter([{{t}}, CASE WHEN doc_id % 5 = 0 THEN {{t}} END], lambda x: x IS NOT NULL), '|') AS texts
FROM (SELECT doc_id, {clean('text')} AS t FROM documents) WHERE {words('t')} >= 6
""".replace("{t}", "t")


@register("extract_json_text", _JSON_TEXTS)
def extract_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs_json(spark, sf_dir).select("doc_key", F.col("fields")["body"].alias("value"))
    rows = E.extract_json_text(docs, "value").filter(F.size("texts") > 0)
    return rows.select("doc_key", F.array_join("texts", "|").alias("texts"))


@register(
    "extracted_content_json",
    f"""SELECT CAST(doc_id AS VARCHAR) AS doc_key, t AS text
    FROM (SELECT doc_id, {clean('text')} AS t FROM documents) WHERE {words('t')} >= 6""",
)
def extracted_content_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block values: the nested block repeats the body, which is then written once."""
    return E.extracted_content(T.docs_json(spark, sf_dir)).select("doc_key", "text")


@register(
    "flatten_structured",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_key,
      trim('grid layout of the whole page and more A heading that is long enough to count ' || source || ' ' || text
      || CASE WHEN doc_id % 5 = 0 THEN ' ' || CAST(to_json({'label': 'Home page-square text layout', 'body': text}) AS VARCHAR)
         ELSE '' END) AS value
    FROM documents""",
)
def flatten_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = T.docs_json(spark, sf_dir).select("doc_key", F.col("fields")["body"].alias("value"))
    return E.flatten_structured(docs, "value")


_BODY = f"""
SELECT index_name, doc_key, {clean('name')} AS title, query_id, score,
  t || CASE WHEN length(f_bodytext) >= 80 AND length(t) < 3000
       THEN chr(10) || chr(10) || substring(t, 1, 3000 - length(t)) ELSE '' END AS body
FROM (SELECT *, substring({clean('f_bodytext')}, 1, 3000) AS t FROM hits_text)
"""


@register("assemble_source_text", f"SELECT doc_key, title, body FROM ({_BODY})")
def assemble_source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assemble_source_text(T.docs_text(spark, sf_dir), 3000).select("doc_key", "title", "body")


@register(
    "source_blocks",
    f"""SELECT query_id, string_agg('<source n="' || n || '" title="' || translate(title, '<>', '＜＞') || '">'
        || chr(10) || translate(body, '<>', '＜＞') || chr(10) || '</source>' || chr(10) || chr(10), '' ORDER BY n) AS blocks
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS n FROM ({_BODY}))
    WHERE n <= 4 GROUP BY query_id""",
)
def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = E.assemble_source_text(T.docs_text(spark, sf_dir), 3000)
    return E.source_blocks(T.hits_text(spark, sf_dir), texts)
