"""Registered queries: searches with everything a results page shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from findery.plans.composed import Response, compose
from findery.plans.profiles import rule_tables, search_profiles as run_profiles
from findery.plans.search import index_for
from findery.rules import FieldRule, RuleSet
from findery.workload import tables as T
from findery.workload.describe_queries import _shorten_sql
from findery.workload.extract_queries import squeeze
from findery.workload.registry import register
from findery.workload.search_queries import RULES
from findery.workload.sqlviews import bm25_sql

DESCRIBED = RULES.with_(
    title_fields=("bodytext_en",), description_fields=("bodyText",), description_length=120, type_labels=(("SRC1", "News"),),
    group_by_type=True,
)


def _composed(spark: SparkSession, sf_dir: str, explain: bool = False) -> Response:
    return compose(T.q_text(spark, sf_dir), T.docs_text(spark, sf_dir), DESCRIBED, explain=explain, structured=False)


@register(
    "search_described",
    f"""SELECT r.query_id, r.doc_key, r.rank, CASE WHEN d.culture = 'en' THEN {_shorten_sql(squeeze('d.f_bodytext'), 160)} ELSE d.name END AS name,
      {_shorten_sql(squeeze('d.f_bodytext'), 120)} AS summary, CASE r.type_alias WHEN 'src1' THEN 'News' ELSE r.type_alias END AS type_label
    FROM flag_ranked r JOIN docs_text d ON d.doc_key = r.doc_key WHERE r.rank <= 10""",
)
def search_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir).page.select("query_id", "doc_key", "rank", "name", "summary", "type_label")


@register("search_groups", "SELECT query_id, lower(type_alias) AS type, count(*) AS hits FROM flag_hits GROUP BY ALL")
def search_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir).groups


@register(
    "search_diagnostics",
    """WITH w AS (SELECT query_id, list_sort(string_split(term, ' ')) AS words FROM q_text WHERE term <> '')
    SELECT w.query_id, coalesce(f.n, 0) AS fetched, coalesce(f.n, 0) - coalesce(k.n, 0) AS removed_by_sources, 0 AS removed_by_facets,
      0 AS removed_by_score, 0 AS removed_as_duplicates, coalesce(k.n, 0) AS kept, 'main' AS indexes, 'bodytext,nodename' AS fields,
      'nodename:(' || array_to_string(words, ' ') || ') prefix^10.0; bodytext:(' || array_to_string(words, ' ') || ')^1.0' AS clauses,
      array_to_string(words, ',') AS terms
    FROM w LEFT JOIN (SELECT query_id, count(*) AS n FROM flag_window GROUP BY ALL) f ON f.query_id = w.query_id
    LEFT JOIN (SELECT query_id, count(*) AS n FROM flag_hits GROUP BY ALL) k ON k.query_id = w.query_id""",
)
def search_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _composed(spark, sf_dir, explain=True).diagnostics


NEWS = RuleSet(
    fields=(FieldRule("bodyText", 3.0, "exact"),), include_content_types=tuple(f"SRC{i}" for i in range(4, 10)),
    published_only=False, stop_words=("the", "and"), page_size=5, index_names=("main",),
)


@register(
    "search_profiles",
    f"""SELECT query_id, doc_key, score, rank FROM flag_ranked WHERE query_id % 2 = 0 AND rank <= 10
    UNION ALL SELECT query_id, doc_key, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (
        SELECT query_id, doc_key, round(3 * sum(weight), 6) AS score FROM (
          {bm25_sql("""SELECT w.query_id, w.group_no, v.index_name, v.field, v.term FROM words_text w JOIN vocab_text v
            ON v.field = 'bodytext' AND v.term = w.variant WHERE w.variant NOT IN ('the', 'and')""")})
        WHERE query_id % 2 = 1 AND type_alias IN ('src4', 'src5', 'src6', 'src7', 'src8', 'src9') GROUP BY ALL)) WHERE rank <= 5""",
)
def search_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even queries search the flagship's profile, odd ones another with rules of its own, in one plan."""
    docs = T.docs_text(spark, sf_dir)
    queries = T.q_text(spark, sf_dir).withColumn("profile_alias", F.when(F.col("query_id") % 2 == 0, "Site").otherwise("news"))
    rules = rule_tables(spark, {"site": RULES, "News": NEWS})
    return run_profiles(queries, docs, rules, index_for(docs, RULES, cultures=False)).page.select("query_id", "doc_key", "score", "rank")
