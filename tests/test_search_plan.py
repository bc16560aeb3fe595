"""How whole searches run: what they read, and what one task may meet."""

import random

import pytest
from pyspark.sql import functions as F

from findery.operators import match as M, postings as P, rank as R, score as S
from findery.plans import search as PL
from findery.rules import FieldRule, RuleSet, SortOption, SortRule
from findery.workload import tables as T

RULES = RuleSet(
    fields=(FieldRule("nodename", 10.0, "prefix"), FieldRule("bodytext", 1.0, "wildcard"), FieldRule("bodytext", 2.0, "fuzzy")),
    include_content_types=tuple(f"src{i}" for i in range(20)), hide_fields=("hideFromSearch",), sort_by=(SortRule("n_chars"),),
    sort_options=(SortOption("size", "Size", "n_chars", "descending"),),
)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    PL.index_for(T.docs_text(spark, sf_dir), RULES).write(path)
    return P.read_index(spark, path)


def asked(spark, sf_dir):
    return T.q_text(spark, sf_dir).limit(6).withColumn("sort", F.when(F.col("query_id") % 2 == 0, "size"))


def test_kept_index_answers_without_reading_documents(spark, sf_dir, kept):
    docs, queries = T.docs_text(spark, sf_dir), asked(spark, sf_dir)
    unread = docs.withColumn("fields", F.raise_error(F.lit("the texts are read")).cast("map<string,string>"))
    columns = ["query_id", "doc_key", "score", "rank"]
    got = PL.search(queries, unread, RULES, index=kept)
    want = PL.search(queries, docs, RULES)
    assert rows(got.page, *columns) == rows(want.page, *columns) and got.page.count()
    assert rows(got.totals, "query_id", "total") == rows(want.totals, "query_id", "total")


def test_forward_index_is_joined_in_its_buckets(spark, sf_dir, kept):
    hits = kept.forward.rows.select("index_name", "doc_key").limit(5000).withColumn("query_id", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = hits.join(kept.forward.attributes(RULES), ["index_name", "doc_key"])._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_rules_the_index_does_not_hold_fall_back_to_the_documents(spark, sf_dir, kept):
    docs, queries = T.docs_text(spark, sf_dir), asked(spark, sf_dir)
    wider = RULES.with_(dedup_field="n_chars")
    assert kept.forward.covers(RULES) and not kept.forward.covers(wider)
    assert PL.search(queries, docs, wider, index=kept).page.count()


@pytest.mark.parametrize("limit", [1, 7, 2000])
def test_first_rows_equal_a_full_sort(spark, limit):
    draw = random.Random(limit)
    # One group holds nearly everything; many scores are equal.
    data = [("hot" if draw.random() < 0.9 else f"g{i % 5}", str(i), float(draw.randint(0, 9))) for i in range(1500)]
    frame = spark.createDataFrame(data, "query_id string, doc_key string, score double").repartition(6)
    got = R.first_rows(frame, ["query_id"], [F.desc("score"), F.asc("doc_key")], limit, "rank")
    want = []
    for name in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == name), key=lambda d: (-d[2], d[1]))
        want += [(*d, k) for k, d in enumerate(own[:limit], 1)]
    assert rows(got, "query_id", "doc_key", "score", "rank") == sorted(want)


def test_no_task_meets_all_rows_of_a_hot_query(spark):
    """The last window sees pieces x limit rows of a query at most."""
    frame = spark.range(20_000).select((F.col("id") % 7).alias("query_id"), F.col("id").cast("string").alias("doc_key"), F.rand(3).alias("score"))
    page = R.first_rows(frame, ["query_id"], [F.desc("score"), F.asc("doc_key")], 10, "rank")
    text = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert text.count("WindowGroupLimit") >= 3 and "hashpartitioning(query_id" in text


def test_pages_and_totals_of_every_query(spark, sf_dir):
    hits = T.hits_parts(spark, sf_dir)
    ids = hits.select("query_id").distinct().withColumns({"term": F.lit("x"), "page": F.lit(2), "page_size": F.lit(4)})
    page, totals = R.page_slice(hits, T.query_defaults(ids))
    ranked, _ = R.page_slice(R.rank_hits(hits), T.query_defaults(ids))
    assert rows(page, "query_id", "doc_key", "rank") == rows(ranked, "query_id", "doc_key", "rank")
    assert sum(r.total for r in totals.collect()) == hits.count()


@pytest.mark.parametrize("mode", ["prefix", "wildcard", "fuzzy"])
def test_kept_keys_match_like_the_vocabulary(spark, sf_dir, kept, mode):
    words = T.q_words(spark, sf_dir).select("query_id", F.lit(0).alias("group_no"), F.lit(0).alias("variant_no"), F.col("term").alias("variant"))
    match = {"prefix": M.match_prefix, "wildcard": M.match_wildcard, "fuzzy": lambda w, v, keys=None: M.match_fuzzy(w, v, 0.5, keys)}[mode]
    with_keys = match(words, kept.vocab, keys=kept.keys)
    assert with_keys.exceptAll(match(words, kept.vocab).select(with_keys.columns)).isEmpty()
    assert with_keys.count() == match(words, kept.vocab).count() > 0


def test_one_letter_words(spark):
    vocab = spark.createDataFrame([("i", "f", t, 1) for t in ("a", "ab", "ba", "abc", "é")], "index_name string, field string, term string, df int")
    words = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "A"), (3, 0, 0, "é")], "query_id int, group_no int, variant_no int, variant string")
    found = {r.query_id: set() for r in words.collect()}
    for r in M.match_prefix(words, vocab).collect():
        found[r.query_id].add(r.term)
    assert found == {1: {"a", "ab", "abc"}, 2: {"a", "ab", "abc"}, 3: {"é"}}
    assert {r.term for r in M.match_wildcard(words, vocab).collect() if r.query_id == 1} == {"a", "ab", "ba", "abc"}


def test_browse_queries_need_no_flag(spark, sf_dir):
    docs = T.docs_parts(spark, sf_dir)
    queries = T.query_defaults(spark.createDataFrame([(1, " ", True), (2, "red", False)], "query_id int, term string, allow_empty boolean"))
    rules = RuleSet(fields=(FieldRule("nodename"),), include_content_types=("promo", "economy", "large", "standard", "small", "medium"))
    totals = {r.query_id: r.total for r in PL.search(queries, docs, rules).totals.collect()}
    assert totals[1] == docs.count() > totals[2] > 0


def test_profile_without_fields_and_without_searchable_ones(spark, sf_dir):
    docs = T.docs_parts(spark, sf_dir).withColumn("fields", F.create_map(F.lit("__secret"), F.lit("red")))
    queries = T.query_defaults(spark.createDataFrame([(1, "red")], "query_id int, term string"))
    rules = RuleSet(include_content_types=("promo", "economy", "large", "standard", "small", "medium"))
    found = PL.search(queries, docs, rules).hits
    assert found.count() == docs.filter("lower(name) rlike '(^|[^a-z])red'").count() > 0


def test_two_rules_on_one_field_add_up(spark, sf_dir):
    docs, queries = T.docs_text(spark, sf_dir), T.q_words(spark, sf_dir).limit(5)
    types = tuple(f"src{i}" for i in range(20))

    def scores(*boosts):
        rules = RuleSet(fields=tuple(FieldRule("bodytext", b, "exact") for b in boosts), include_content_types=types, minimum_length=1)
        return {(r.query_id, r.doc_key): r.score for r in PL.search(queries, docs, rules, cultures=False).scored.collect()}

    both, seven = scores(2.0, 5.0), scores(7.0)
    assert both.keys() == seven.keys() and all(abs(both[k] - seven[k]) < 1e-5 for k in both)


def test_and_over_fields_counts_every_rule(spark):
    rows_ = [(1, "i", "d", "f", 0, 1.0, 1.0, 2), (1, "i", "e", "f", 0, 1.0, 1.0, 2), (1, "i", "d", "f", 1, 1.0, 1.0, 2)]
    weights = spark.createDataFrame(rows_, "query_id int, index_name string, doc_key string, field string, rule_no int, weight double, boost double, n_fields int")
    found = S.match_field_operator(weights, "and").collect()
    assert [(r.doc_key, r.raw_score) for r in found] == [("d", 2.0)]
