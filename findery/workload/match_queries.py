"""Registered queries: terms, fields, postings, matching and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.operators import match as M, postings as P, score as S, terms as TM
from findery.rules import FieldRule, RuleSet
from findery.session import store
from findery.sources.indexes import discover_fields
from findery.workload import tables as T
from findery.workload.registry import register
from findery.workload.sqlviews import bm25_sql

STOP_WORDS = ("the", "a", "of", "and")
SYNONYMS = (("bolt", "screw"), ("gear", "cog"), ("in", "inside the"))


@register(
    "normalize_terms",
    r"""SELECT query_key, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) AS normalized_term
    FROM raw_searches""",
)
def normalize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.normalize_terms(T.raw_searches(spark, sf_dir), "term").select("query_key", "normalized_term")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("term"))
    return T.query_defaults(rows)


@register(
    "term_groups",
    r"""WITH w AS (SELECT query_id, unnest(range(len(ws))) AS group_no, unnest(ws) AS word FROM (
      SELECT item_id AS query_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'),
        lambda x: x <> '' AND lower(x) NOT IN ('the', 'a', 'of', 'and')) AS ws FROM benchmark))
    SELECT query_id, group_no, 0 AS variant_no, word AS variant FROM w
    UNION ALL SELECT query_id, group_no, 1, CASE lower(word) WHEN 'bolt' THEN 'screw' WHEN 'gear' THEN 'cog'
      ELSE 'inside the' END FROM w WHERE lower(word) IN ('bolt', 'gear', 'in')""",
)
def term_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.term_groups(_passages(spark, sf_dir), STOP_WORDS, SYNONYMS)


_CLASSED = RuleSet(
    fields=(FieldRule("p_brand"),), minimum_length=2, blocked_terms=("blue k0", " Blue K18 "),
    stop_words=("blue", "k2", "k7"), include_content_types=("ECONOMY",), index_names=("Parts", "gone"),
)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover_fields(T.docs_parts(spark, sf_dir))


@register(
    "classify_queries",
    r"""SELECT query_id, CASE WHEN term = '' AND NOT browse THEN 'empty' WHEN browse THEN 'ok'
      WHEN length(term) < 2 THEN 'too_short' WHEN term IN ('blue k0', 'blue k18') THEN 'blocked_term'
      WHEN term IN ('blue k2', 'blue k7') THEN 'all_stop_words' ELSE 'ok' END AS status
    FROM (SELECT query_key AS query_id, lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) AS term,
            query_key % 2 = 0 AND trim(term) = '' AS browse FROM raw_searches)""",
)
def classify_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.raw_searches(spark, sf_dir).select(
        F.col("query_key").alias("query_id"), TM.T.normalize_term(F.col("term")).alias("term"),
        (F.col("query_key") % 2 == 0).alias("allow_empty"),
    )
    classed = TM.classify_queries(T.query_defaults(rows), _CLASSED, _catalogue(spark, sf_dir))
    return classed.select("query_id", "status")


@register(
    "resolve_field_rules",
    """SELECT DISTINCT index_name, field, CAST(CASE WHEN field = 'nodename' THEN 10.0 WHEN field LIKE '%title' THEN 5.0
      ELSE 1.0 END AS DOUBLE) AS boost, 'prefix' AS match_mode
    FROM (SELECT index_name, unnest(['bodytext', 'bodytext_' || culture, 'n_chars', 'nodename',
            'pagetitle']) AS field FROM docs_text
          UNION ALL SELECT index_name, 'hidefromsearch' FROM docs_text WHERE f_hidefromsearch IS NOT NULL)""",
)
def resolve_field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = T.docs_text(spark, sf_dir).withColumn("fields", F.map_concat(
        "fields", F.create_map(F.lit("nodename"), F.col("name"), F.lit("pagetitle"), F.col("name"))
    ))
    return TM.resolve_field_rules(discover_fields(named), ())


@register(
    "expand_cultures",
    """SELECT DISTINCT index_name, field, CAST(boost AS DOUBLE) AS boost, match_mode FROM (
      SELECT index_name, 'bodytext_' || culture AS field, 2.0 AS boost, 'exact' AS match_mode FROM docs_text
      WHERE culture IN ('en', 'fr')
      UNION ALL SELECT index_name, 'n_chars', 1.0, 'prefix' FROM docs_text
      UNION ALL SELECT index_name, '__published', 1.0, 'prefix' FROM docs_text)""",
)
def expand_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = discover_fields(T.docs_text(spark, sf_dir))
    rules = (FieldRule("bodyText", 2.0, "exact"), FieldRule("n_chars"), FieldRule("__published"))
    fields = TM.resolve_field_rules(catalogue, rules)
    return TM.expand_cultures(fields, ("EN", "fr", "xx"), catalogue)


def _index(spark: SparkSession, sf_dir: str) -> P.SearchIndex:
    return P.build_postings(T.docs_text(spark, sf_dir), ["nodename", "bodytext"])


@register("build_postings", "SELECT field, term, doc_key, doc_len, tf FROM post_text")
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).postings.select("field", "term", "doc_key", "doc_len", "tf")


@register("postings_vocab", "SELECT field, term, df FROM vocab_text")
def postings_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).vocab.select("field", "term", "df")


@register("postings_stats", "SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM stats_text")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TM.term_groups(T.q_words(spark, sf_dir))


def _match_sql(variant: str, condition: str) -> str:
    return f"""SELECT w.query_id, 0 AS group_no, w.variant, v.field, v.term, v.df
    FROM (SELECT query_id, {variant} AS variant FROM q_words) w
    JOIN vocab_text v ON {condition}"""


def _matched(frame: DataFrame) -> DataFrame:
    return frame.select("query_id", "group_no", "variant", "field", "term", "df")


@register("match_exact", _match_sql("term", "v.term = w.variant"))
def match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    vocab = _index(spark, sf_dir).vocab_of(words.select(F.lower("variant").alias("term")).distinct())
    return _matched(M.match_exact(words, vocab))


@register("match_prefix", _match_sql("term", "starts_with(v.term, w.variant)"))
def match_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(M.match_prefix(_words(spark, sf_dir), _index(spark, sf_dir).vocab))


@register("match_wildcard", _match_sql("term", "contains(v.term, w.variant)"))
def match_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(M.match_wildcard(_words(spark, sf_dir), _index(spark, sf_dir).vocab))


_BAD = "substring(term, 1, 2) || substring(term, 4)"


# DuckDB measures edits in bytes, so letters of two bytes are first swapped for unused capitals.
def _ascii(expr: str) -> str:
    return f"translate({expr}, 'áàâäçéèêëíìîïñóòôöúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVW')"


def _fuzzy_sql(fuzziness: str) -> str:
    return _match_sql(
        _BAD,
        f"abs(length(v.term) - length(w.variant)) <= 2 AND levenshtein({_ascii('v.term')}, {_ascii('w.variant')}) "
        f"<= least(2, CAST(floor((1 - {fuzziness}) * length(w.variant) + 1e-9) AS INT))",
    )


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.concat(F.substring("variant", 1, 2), F.substring("variant", 4, 1000))
    return _words(spark, sf_dir).withColumn("variant", bad)


@register("match_fuzzy", _fuzzy_sql("0.8"))
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(M.match_fuzzy(_misspelt(spark, sf_dir), _index(spark, sf_dir).vocab))


@register("match_fuzzy_wide", _fuzzy_sql("0.5"))
def match_fuzzy_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters and more may differ by two edits, short ones by one."""
    return _matched(M.match_fuzzy(_misspelt(spark, sf_dir), _index(spark, sf_dir).vocab, 0.5))


_WEIGHTS = bm25_sql("""SELECT w.query_id, w.group_no, v.index_name, v.field, v.term FROM words_text w
  JOIN vocab_text v ON starts_with(v.term, w.variant) WHERE v.field IN ('nodename', 'bodytext')""")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each passage by their beginnings, names at 10."""
    queries = T.q_text(spark, sf_dir).withColumn("n_groups", F.size(F.split("term", " ")))
    fields = F.create_map(F.lit("nodename"), F.lit(10.0), F.lit("bodytext"), F.lit(1.0))
    words = TM.term_groups(queries, carry=("n_groups",)).select("*", F.explode(fields).alias("field", "boost"))
    return words.withColumns({"index_name": F.lit("main"), "match_mode": F.lit("prefix"), "n_fields": F.lit(2)})


def _search(spark: SparkSession, sf_dir: str) -> tuple:
    index = _index(spark, sf_dir)
    index = P.from_postings(store(index.postings.filter(F.col("field").isin("nodename", "bodytext"))))
    return _asked(spark, sf_dir), lambda words: M.match_prefix(words, index.vocab), index.postings, index.stats


def _per_field(require_all: str) -> str:
    return f"""SELECT query_id, field, doc_key, sum(weight) AS weight FROM (
      SELECT query_id, field, doc_key, group_no, max(weight) AS weight FROM ({_WEIGHTS}) GROUP BY ALL)
    JOIN (SELECT query_id, len(string_split(term, ' ')) AS n_words FROM q_text) USING (query_id)
    GROUP BY query_id, field, doc_key, n_words HAVING count(*) >= {require_all}"""


@register("match_all_terms", f"SELECT query_id, field, doc_key, round(weight, 6) AS weight FROM ({_per_field('n_words')})")
def match_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.field_scores(*_search(spark, sf_dir), require_all=True)
    return rows.select("query_id", "field", "doc_key", F.round("weight", 6).alias("weight"))


@register(
    "match_field_operator",
    f"""SELECT query_id, doc_key, round(sum(CASE WHEN field = 'nodename' THEN 10 ELSE 1 END * weight), 6) AS raw_score
    FROM ({_per_field('1')}) GROUP BY ALL HAVING count(*) = 2""",
)
def match_field_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_bm25(*_search(spark, sf_dir), op="and").drop("index_name")


_SCORED = f"""SELECT query_id, doc_key, round(sum(CASE WHEN field = 'nodename' THEN 10 ELSE 1 END * weight), 6) AS raw_score
    FROM ({_per_field('1')}) GROUP BY ALL"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_bm25(*_search(spark, sf_dir))


@register("score_bm25", _SCORED)
def score_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).drop("index_name")


@register(
    "fetch_window",
    f"""SELECT query_id, doc_key, raw_score, fetch_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, doc_key) AS fetch_rank
      FROM ({_SCORED})) WHERE fetch_rank <= 20""",
)
def fetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fetch_window(_scored(spark, sf_dir), 20).drop("index_name")
