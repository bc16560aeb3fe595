"""The composed search against its parts."""

import pytest
from pyspark.sql import functions as F

from findery.plans import search as PL
from findery.plans.composed import compose, rerankable
from findery.rules import FieldRule, Highlight, RuleSet, SortOption
from findery.workload import tables as T

TYPES = ("promo", "economy", "large", "standard", "small", "medium")
RULES = RuleSet(
    fields=(FieldRule("nodename", 1.0, "prefix"),), include_content_types=TYPES, page_size=5,
    sort_options=(SortOption("price", "Price", "p_retailprice"), SortOption("best", "Best", "score")),
)


def asked(spark):
    rows = [(1, "red", 1, None, False), (2, "red", 2, None, False), (3, "red", 1, "price", False), (4, "red", 1, "best", False), (5, " ", 1, None, True)]
    return T.query_defaults(spark.createDataFrame(rows, "query_id int, term string, page int, sort string, allow_empty boolean"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return T.docs_parts(spark, sf_dir)


def test_only_first_pages_by_relevance_are_reranked(spark, docs):
    queries = asked(spark)
    assert {r.query_id for r in rerankable(queries, RULES).collect()} == {1, 4}
    replies = queries.select("query_id", F.lit('{"order": [7, 2]}').alias("reply"))
    plain = compose(queries, docs, RULES)
    got = compose(queries, docs, RULES.with_(rerank_depth=10), replies=replies)
    deep = PL.search(queries.withColumn("page_size", F.lit(10)), docs, RULES).page

    def page(frame, query):
        return [r.doc_key for r in frame.filter(F.col("query_id") == query).orderBy("rank").collect()]

    for query in (2, 3, 5):
        assert page(got.page, query) == page(plain.page, query)
    ten = page(deep, 1)
    moved = [ten[6], ten[1], *[d for i, d in enumerate(ten) if i not in (1, 6)]]
    assert page(got.page, 1) == page(got.page, 4) == moved[:5]
    keys = ["query_id", "total", "page", "page_size", "total_pages", "has_more"]
    assert sorted(got.totals.select(keys).collect()) == sorted(plain.totals.select(keys).collect())


def test_curated_page_has_totals_of_its_own(spark, docs):
    found = compose(asked(spark), docs, RULES.with_(curated=("7", "missing", "3")))
    page = found.page.filter("query_id = 5").orderBy("rank").collect()
    assert [(r.doc_key, r.rank) for r in page] == [("7", 1), ("3", 2)]
    totals = {r.query_id: r for r in found.totals.collect()}
    own = totals[5]
    assert (own.total, own.page, own.page_size, own.total_pages, own.has_more) == (2, 1, 2, 1, False)
    assert totals[1].total > 5 and totals[1].has_more
    none = compose(asked(spark), docs, RULES.with_(curated=("missing",)))
    assert {r.query_id: r.total for r in none.totals.collect()}[5] == docs.count()


def test_snippets_win_over_descriptions(spark, sf_dir):
    docs = T.docs_text(spark, sf_dir)
    queries = T.q_text(spark, sf_dir).limit(4)
    rules = RuleSet(fields=(FieldRule("bodytext", 1.0, "exact"),), include_content_types=tuple(f"src{i}" for i in range(20)), page_size=3,
                    description_fields=("bodytext",), highlight=Highlight("window", length=80), return_fields=("n_chars",))
    page = compose(queries, docs, rules, structured=False).page
    rows = page.collect()
    assert rows and all("<mark>" in r.summary for r in rows)
    assert all(set(r.fields) <= {"n_chars", "nodename", "__nodename", "__nodetypealias", "createdate", "updatedate"} for r in rows)
    plain = compose(queries, docs, rules.with_(highlight=Highlight("window", length=80, mark=False)), structured=False).page.collect()
    strip = lambda s: s.replace("<mark>", "").replace("</mark>", "")
    assert sorted((r.query_id, r.doc_key, strip(r.summary)) for r in rows) == sorted((r.query_id, r.doc_key, r.summary) for r in plain)


def test_groups_facets_diagnostics_and_spelling(spark, docs):
    queries = T.query_defaults(spark.createDataFrame([(1, "red"), (2, "rde bolt")], "query_id int, term string"))
    found = compose(queries, docs, RULES.with_(group_by_type=True, fuzziness=0.5, minimum_score=1.0), explain=True, spelling_below=3)
    totals = {r.query_id: r.total for r in found.totals.collect()}
    grouped = {r.query_id: r.n for r in found.groups.groupBy("query_id").agg(F.sum("hits").alias("n")).collect()}
    assert all(grouped.get(q, 0) == n for q, n in totals.items())
    explained = {r.query_id: r for r in found.diagnostics.collect()}
    one = explained[1]
    assert one.kept == totals[1] and one.fetched == one.kept + one.removed_by_sources + one.removed_by_facets + one.removed_by_score + one.removed_as_duplicates
    assert (one.indexes, one.fields, one.terms, one.clauses) == ("parts", "nodename", "red", "nodename:(red) prefix^1.0")
    assert found.facets is None


def test_duplicates_stay_where_the_switch_is_off(spark, docs):
    queries = T.query_defaults(spark.createDataFrame([(1, "red")], "query_id int, term string"))
    on = compose(queries, docs, RULES.with_(dedup_field="p_brand")).totals.first().total
    off = compose(queries, docs, RULES.with_(dedup_field="p_brand", deduplicate=False)).totals.first().total
    assert on < off
