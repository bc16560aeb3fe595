"""Registered queries: whole searches, suggestions and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from findery.operators import sets as ST, suggest as SG
from findery.plans import search as PL
from findery.rules import BestBet, Facet, FieldRule, RuleSet
from findery.workload import tables as T
from findery.workload.registry import register
from findery.workload.sqlviews import VIEWS, bm25_sql

RULES = RuleSet(
    fields=(FieldRule("nodeName", 10.0, "prefix"), FieldRule("bodyText", 1.0, "exact")),
    include_content_types=tuple(f"src{i}" for i in range(18)), exclude_types=("src3",),
    hide_fields=("hideFromSearch",), type_boosts=(("src1", 2.0), ("src2", 0.5)), root_ids=(-1,), excluded_ids=(5,),
    best_bets=(BestBet(("the",), ("1",)),), page_size=10,
)

# Word weights of the flagship's two fields: the name by beginnings, the body by whole words.
VIEWS["flag_weights"] = bm25_sql("""
  SELECT w.query_id, w.group_no, v.index_name, v.field, v.term FROM words_text w JOIN vocab_text v
    ON v.field = 'nodename' AND starts_with(v.term, w.variant)
  UNION ALL SELECT w.query_id, w.group_no, v.index_name, v.field, v.term FROM words_text w JOIN vocab_text v
    ON v.field = 'bodytext' AND v.term = w.variant""")
VIEWS["flag_window"] = """
SELECT query_id, doc_key, raw_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, doc_key) AS fetch_rank FROM (
    SELECT query_id, doc_key, round(sum(CASE WHEN field = 'nodename' THEN 10 ELSE 1 END * weight), 6) AS raw_score FROM (
      SELECT query_id, field, doc_key, sum(weight) AS weight FROM (
        SELECT query_id, field, doc_key, group_no, max(weight) AS weight FROM flag_weights
        WHERE type_alias NOT IN ('src3', 'src18', 'src19') GROUP BY ALL) GROUP BY ALL) GROUP BY ALL))
"""
VIEWS["flag_hits"] = """
SELECT query_id, doc_key, raw_score, name, type_alias, culture,
  CAST(round(CAST(raw_score AS DECIMAL(18, 6)) * CASE type_alias WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END, 6) AS DOUBLE) AS score,
  doc_key = '1' AND query_id IN (SELECT query_id FROM words_text WHERE variant = 'the') AS is_best_bet
FROM flag_window JOIN docs_text USING (doc_key)
WHERE f_hidefromsearch IS NULL AND coalesce(f_published, 'y') = 'y' AND NOT list_contains(path, 5)
"""
VIEWS["flag_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_best_bet DESC, score DESC, raw_score DESC, doc_key) AS rank FROM flag_hits
"""


def _flag(spark: SparkSession, sf_dir: str, rules: RuleSet = RULES, queries: DataFrame | None = None) -> PL.SearchResult:
    return PL.search(queries or T.q_text(spark, sf_dir), T.docs_text(spark, sf_dir), rules, cultures=False)


@register("search_batch", "SELECT query_id, doc_key, name, score, rank FROM flag_ranked WHERE rank <= 10")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = PL.search_batch(T.q_text(spark, sf_dir), T.docs_text(spark, sf_dir), RULES, cultures=False)
    return page.select("query_id", "doc_key", "name", "score", "rank")


@register(
    "search_totals",
    """SELECT q.query_id, count(r.doc_key) AS total, CAST(ceil(count(r.doc_key) / 10) AS BIGINT) AS total_pages
    FROM q_text q LEFT JOIN flag_ranked r ON r.query_id = q.query_id GROUP BY ALL""",
)
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flag(spark, sf_dir).totals.select("query_id", "total", "total_pages")


_SOURCE = Facet("source", "contentType")


@register(
    "search_facets",
    "SELECT query_id, 'source' AS facet, type_alias AS value, count(*) AS n FROM flag_hits GROUP BY ALL",
)
def search_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even queries select two sources; the facet's own selection leaves its counts alone."""
    queries = _selected(spark, sf_dir)
    found = _flag(spark, sf_dir, RULES.with_(facets=(_SOURCE,), best_bets=()), queries).facets
    return found.withColumn("n", F.col("n").cast("bigint"))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.create_map(F.lit("source"), F.array(F.lit("SRC1"), F.lit("src2")))
    none = F.create_map().cast("map<string,array<string>>")
    return T.q_text(spark, sf_dir).withColumn("filters", F.when(F.col("query_id") % 2 == 0, chosen).otherwise(none))


@register(
    "fallback_union",
    """WITH f AS (SELECT *, query_id % 2 = 0 AS narrowed FROM flag_hits),
      kept AS (SELECT * FROM f WHERE NOT narrowed OR type_alias IN ('src1', 'src2')),
      again AS (SELECT * FROM f WHERE narrowed AND query_id NOT IN (SELECT query_id FROM kept))
    SELECT query_id, doc_key, score FROM (SELECT * FROM kept UNION ALL SELECT * FROM again)""",
)
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred filters that leave nothing are taken back."""
    rules = RULES.with_(facets=(_SOURCE,), best_bets=())
    docs = T.docs_text(spark, sf_dir)
    index = PL.index_for(docs, rules, cultures=False)
    found = ST.fallback_union(
        T.q_text(spark, sf_dir), _selected(spark, sf_dir),
        lambda q: PL.search(q, docs, rules, index=index).hits.select("query_id", "doc_key", "score"),
    )
    return found


@register(
    "search_cultures",
    """SELECT query_id, doc_key, raw_score FROM (
      SELECT query_id, doc_key, round(sum(weight), 6) AS raw_score FROM (
        SELECT query_id, field, doc_key, group_no, max(weight) AS weight FROM ("""
    + bm25_sql("""SELECT w.query_id, w.group_no, v.index_name, v.field, v.term FROM words_text w JOIN vocab_text v ON v.term = w.variant
      AND v.field IN (CASE WHEN w.query_id % 2 = 0 THEN 'bodytext_en' ELSE 'bodytext' END, CASE WHEN w.query_id % 2 = 0 THEN 'bodytext_fr' END)""")
    + ") GROUP BY ALL) GROUP BY ALL)",
)
def search_cultures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even queries ask for two cultures and search those variants instead of the plain field."""
    wanted = F.when(F.col("query_id") % 2 == 0, F.array(F.lit("EN"), F.lit("fr"), F.lit("xx"))).otherwise(
        F.array().cast("array<string>")
    )
    queries = T.q_text(spark, sf_dir).withColumn("cultures", wanted)
    rules = RuleSet(fields=(FieldRule("bodyText", 1.0, "exact"),), include_content_types=tuple(f"src{i}" for i in range(20)))
    docs = T.docs_text(spark, sf_dir)
    found = PL.windowed(queries, docs, rules, PL.windows_index(docs, rules), False)
    return found.select("query_id", "doc_key", "raw_score")


VIEWS["tok_every"] = """
SELECT *, list_filter(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS toks FROM (
  SELECT index_name, doc_key, 'nodename' AS field, name AS value FROM docs_text
  UNION ALL SELECT index_name, doc_key, 'bodytext', f_bodytext FROM docs_text
  UNION ALL SELECT index_name, doc_key, 'bodytext_' || culture, f_bodytext FROM docs_text
  UNION ALL SELECT index_name, doc_key, 'n_chars', f_n_chars FROM docs_text
  UNION ALL SELECT index_name, doc_key, 'hidefromsearch', f_hidefromsearch FROM docs_text) WHERE value IS NOT NULL
"""
VIEWS["post_every"] = """
SELECT index_name, doc_key, field, term, doc_len, count(*) AS tf FROM (
  SELECT index_name, doc_key, field, unnest(toks) AS term, len(toks) AS doc_len FROM tok_every) GROUP BY ALL
"""
VIEWS["weigh_every"] = """
SELECT p.doc_key, p.field, p.term, ln(1 + (s.n_docs - v.df + 0.5) / (v.df + 0.5)) * p.tf * 2.2
  / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / s.avg_len)) AS weight
FROM post_every p
JOIN (SELECT field, term, count(*) AS df FROM post_every GROUP BY ALL) v ON v.field = p.field AND v.term = p.term
JOIN (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_len FROM tok_every WHERE len(toks) > 0 GROUP BY ALL) s ON s.field = p.field
"""
EVERY_TYPE = tuple(f"src{i}" for i in range(20))
_SHOWN = "WHERE f_hidefromsearch IS NULL AND coalesce(f_published, 'y') = 'y'"


@register(
    "search_discovered_fields",
    f"""SELECT query_id, doc_key, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (
        SELECT query_id, doc_key, round(sum(CASE WHEN field = 'nodename' THEN 10 ELSE 1 END * weight), 6) AS score FROM (
          SELECT query_id, field, doc_key, max(weight) AS weight FROM q_words q JOIN weigh_every w ON starts_with(w.term, q.term) GROUP BY ALL)
        GROUP BY ALL) JOIN (SELECT doc_key FROM docs_text {_SHOWN}) USING (doc_key)) WHERE rank <= 10""",
)
def search_discovered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile without fields searches every field its index offers, the name at 10, each by beginnings."""
    rules = RuleSet(include_content_types=EVERY_TYPE, hide_fields=("hideFromSearch",), minimum_length=1)
    page = PL.search(T.q_words(spark, sf_dir), T.docs_text(spark, sf_dir), rules).page
    return page.select("query_id", "doc_key", "score", "rank")


@register(
    "search_two_rules",
    f"""SELECT query_id, doc_key, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (
        SELECT query_id, doc_key, round(sum(boost * weight), 6) AS score FROM (
          SELECT q.query_id, w.doc_key, 2 AS boost, w.weight FROM q_words q JOIN weigh_every w ON w.field = 'bodytext' AND w.term = q.term
          UNION ALL SELECT query_id, doc_key, 5, max(weight) FROM q_words q JOIN weigh_every w
            ON w.field = 'bodytext' AND starts_with(w.term, q.term) GROUP BY ALL)
        GROUP BY ALL) JOIN (SELECT doc_key FROM docs_text {_SHOWN}) USING (doc_key)) WHERE rank <= 10""",
)
def search_two_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field under two rules, whole words at 2 and beginnings at 5: both count."""
    fields = (FieldRule("bodyText", 2.0, "exact"), FieldRule("bodytext", 5.0, "prefix"))
    rules = RuleSet(fields=fields, include_content_types=EVERY_TYPE, hide_fields=("hideFromSearch",), minimum_length=1)
    page = PL.search(T.q_words(spark, sf_dir), T.docs_text(spark, sf_dir), rules, cultures=False).page
    return page.select("query_id", "doc_key", "score", "rank")


PART_TYPES = ("PROMO", "ECONOMY", "LARGE", "STANDARD", "SMALL", "MEDIUM")
PART_RULES = RuleSet(include_content_types=PART_TYPES, fields=(FieldRule("nodeName"),))


@register(
    "browse_all",
    """SELECT q.query_id, p.doc_key, p.fetch_rank FROM (SELECT DISTINCT query_id FROM hits_parts WHERE query_id % 2 = 0) q
    CROSS JOIN (SELECT doc_key, row_number() OVER (ORDER BY doc_key) AS fetch_rank FROM docs_parts WHERE type_alias IN ('PROMO', 'LARGE')) p
    WHERE p.fetch_rank <= 50""",
)
def browse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = T.hits_parts(spark, sf_dir).select("query_id").distinct()
    queries = T.query_defaults(ids.withColumns({"term": F.lit("  "), "allow_empty": F.col("query_id") % 2 == 0}))
    rules = PART_RULES.with_(include_content_types=("promo", "LARGE"), max_results=50)
    return PL.browse_all(queries, T.docs_parts(spark, sf_dir), rules).select("query_id", "doc_key", "fetch_rank")


# Scores of part names for the words of a query view: terms matching `test`, boost 2.
def _name_scores(queries: str, test: str) -> str:
    return f"""SELECT query_id, doc_key, name, round(2 * sum(weight), 6) AS score FROM (
      SELECT query_id, doc_key, name, word_no, max(weight) AS weight FROM (
        SELECT w.query_id, w.word_no, p.doc_key, p.name, ln(1 + (s.n - v.df + 0.5) / (v.df + 0.5)) * p.tf * 2.2
          / (p.tf + 1.2 * (0.25 + 0.75 * p.len / s.avg_len)) AS weight
        FROM (SELECT query_id, unnest(range(len(ws))) AS word_no, unnest(ws) AS word FROM (
                SELECT query_id, list_filter(string_split(term, ' '), lambda x: x <> '') AS ws FROM {queries})) w
        JOIN name_vocab v ON {test} JOIN name_post p ON p.term = v.term CROSS JOIN name_stats s)
      GROUP BY ALL) GROUP BY ALL"""


VIEWS["name_post"] = """
SELECT doc_key, name, term, len, count(*) AS tf FROM (
  SELECT doc_key, name, unnest(string_split(lower(name), ' ')) AS term, len(string_split(name, ' ')) AS len FROM docs_parts) GROUP BY ALL
"""
VIEWS["name_vocab"] = "SELECT term, count(*) AS df FROM name_post GROUP BY ALL"
VIEWS["name_stats"] = "SELECT count(*) AS n, avg(len(string_split(name, ' '))) AS avg_len FROM docs_parts"
VIEWS["typed_hits"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM ({_name_scores('q_typed', 'starts_with(v.term, w.word)')})
"""
_EDITS = "levenshtein(v.term, w.word) <= least(2, CAST(floor(0.4 * length(w.word) + 1e-9) AS INT))"
VIEWS["fuzzy_hits"] = f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM ({_name_scores('q_misspelt', _EDITS)})
"""


@register("search_names_only", "SELECT query_id, doc_key, name, score, rank FROM typed_hits WHERE rank <= 30")
def search_names_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = PL.search_names_only(T.q_typed(spark, sf_dir), T.docs_parts(spark, sf_dir), PART_RULES, "prefix", n=30)
    return hits.drop("index_name")


_VOCABULARY = """(SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM (
  SELECT query_id, arg_min(word, rank * 100 + pos) AS word, min(rank * 100 + pos) AS place FROM (
    SELECT query_id, rank, unnest(range(len(string_split(name, ' ')))) AS pos, unnest(string_split(name, ' ')) AS word FROM fuzzy_hits WHERE rank <= 50)
  WHERE length(word) > 2 GROUP BY query_id, lower(word)))"""


def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.search_names_only(T.q_misspelt(spark, sf_dir), T.docs_parts(spark, sf_dir), PART_RULES, "fuzzy", 0.6, 50)


@register("suggestion_vocabulary", f"SELECT query_id, word, place FROM {_VOCABULARY}")
def suggestion_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = SG.suggestion_vocabulary(_fuzzy(spark, sf_dir))
    order = Window.partitionBy("query_id").orderBy("place")
    return words.withColumn("place", F.row_number().over(order))


@register(
    "spell_correct",
    f"""SELECT query_id, word AS suggestion FROM (SELECT q.query_id, v.word, row_number() OVER (PARTITION BY q.query_id
        ORDER BY levenshtein(lower(q.term), lower(v.word)), v.place) AS k
      FROM q_misspelt q JOIN {_VOCABULARY} v ON v.query_id = q.query_id
      WHERE levenshtein(lower(q.term), lower(v.word)) <= least(3, greatest(1, length(q.term) // 3))) WHERE k = 1""",
)
def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = T.q_misspelt(spark, sf_dir)
    totals = queries.select("query_id", F.lit(0).alias("total"))
    return PL.suggest_spelling(
        queries, totals, T.docs_parts(spark, sf_dir), PART_RULES.with_(fuzziness=0.6)
    )


_COMPLETED = """SELECT t.query_id, 0 AS kind, h.rank * 100 + p.pos AS place, regexp_extract(t.term, '^(.* )', 1) || p.word AS text
  FROM q_typed t JOIN (SELECT * FROM typed_hits WHERE rank <= 30) h ON h.query_id = t.query_id
  JOIN (SELECT doc_key, unnest(range(len(string_split(name, ' ')))) AS pos, unnest(string_split(name, ' ')) AS word FROM docs_parts) p
    ON p.doc_key = h.doc_key
  WHERE starts_with(lower(p.word), lower(regexp_extract(t.term, '([^ ]*)$', 1))) AND length(p.word) > length(regexp_extract(t.term, '([^ ]*)$', 1))"""


def _taken(rows: str) -> str:
    return f"""SELECT query_id, position, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kind, place) AS position FROM (
      SELECT query_id, arg_min(text, kind * 1000000 + place) AS text, min(kind * 1000000 + place) // 1000000 AS kind,
        min(kind * 1000000 + place) AS place FROM ({rows}) GROUP BY query_id, lower(text))) WHERE position <= 10"""


@register("autocomplete_words", _taken(_COMPLETED))
def autocomplete_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = T.q_typed(spark, sf_dir)
    hits = PL.search_names_only(queries, T.docs_parts(spark, sf_dir), PART_RULES, "prefix", n=30)
    return SG.autocomplete_words(queries, hits, 10)


@register("autocomplete", _taken(
    f"{_COMPLETED} UNION ALL SELECT query_id, 1, rank * 100, name FROM typed_hits WHERE rank <= 30"))
def autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.autocomplete(T.q_typed(spark, sf_dir), T.docs_parts(spark, sf_dir), PART_RULES, 10)
