"""Scores by document: the same whether tasks hold the queries' words or join them, and without rows of query and word in a shuffle."""

import math

import pytest
from pyspark.sql import functions as F

from findery.operators import match as M, score as S
from findery.plans import search as PL
from findery.rules import FieldRule, SortRule
from findery.workload import all_queries, tables as T
from findery.workload.search_queries import RULES

WORDS = "query_id int, index_name string, field string, rule_no int, group_no int, variant string, match_mode string, boost double, n_groups int, n_fields int"


@pytest.fixture(scope="module")
def tables(spark):
    # Query 1: two words, the first with a synonym, in two fields; query 2 in one field under two rules.
    words = [(1, "i", f, 0, g, v, "prefix", b, 2, 2) for f, b in (("name", 10.0), ("body", 1.0)) for g, v in ((0, "Red"), (0, "rose"), (1, "blue"))]
    words += [(2, "i", "body", r, 0, "red", m, b, 1, 2) for r, m, b in ((0, "exact", 2.0), (1, "prefix", 5.0))]
    terms = [("name", "d", "red", 1), ("name", "d", "roses", 2), ("body", "d", "redder", 3), ("body", "d", "blue", 1), ("body", "e", "red", 2), ("name", "e", "blue", 1), ("body", "f", "grey", 1)]
    postings = spark.createDataFrame([("i", f, d, t, n, 4) for f, d, t, n in terms], "index_name string, field string, doc_key string, term string, tf int, doc_len int")
    vocab = postings.groupBy("index_name", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    stats = spark.createDataFrame([("i", "name", 3, 4.0), ("i", "body", 3, 4.0)], "index_name string, field string, n_docs int, avg_len double")
    return spark.createDataFrame(words, WORDS), lambda w: M.match_words(w, vocab, {"exact", "prefix"}, 0.8), postings, stats


def weight(tf, df=1):
    return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_best_variant_of_each_word_in_each_field_and_rule(tables, monkeypatch, held):
    monkeypatch.setattr(S, "HELD_WORDS", held)
    got = {(q, d): s for q, d, s in rows(S.score_bm25(*tables), "query_id", "doc_key", "raw_score")}
    # "red" and "redder" are terms of one document each.
    want = {(1, "d"): 10 * weight(2) + weight(3) + weight(1), (1, "e"): 10 * weight(1) + weight(2), (2, "d"): 5 * weight(3), (2, "e"): 7 * weight(2)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    strict = S.score_bm25(*tables, op="and")
    assert rows(strict, "query_id", "doc_key") == [(1, "d"), (1, "e"), (2, "e")]
    assert rows(S.field_scores(*tables, require_all=True), "query_id", "doc_key", "field") == [
        (1, "d", "body"), (2, "d", "body"), (2, "e", "body"), (2, "e", "body")]


def test_many_documents_are_expanded_in_pieces(tables, monkeypatch):
    whole = rows(S.score_bm25(*tables), "query_id", "doc_key", "raw_score")
    monkeypatch.setattr(S, "EXPANDED", 1)
    assert rows(S.score_bm25(*tables), "query_id", "doc_key", "raw_score") == whole


def test_no_query_finds_nothing(tables):
    words, *others = tables
    assert S.score_bm25(words.filter("query_id = 9"), *others).isEmpty()


def test_rows_of_query_and_word_are_not_shuffled(tables, spark):
    plan = S.score_bm25(*tables)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "hashpartitioning(index_name" in plan and "hashpartitioning(query_id" not in plan


def test_many_matched_terms_are_not_broadcast(tables, spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_TERMS", 0)
    words, match, postings, stats = tables
    terms = match(S.numbered_words(words)).select("word_no", "index_name", "field", "term", "df")
    joined = S.posting_matches(terms, postings, stats)
    plan = joined._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "BroadcastHashJoin" not in plan and joined.count() > 0


def test_documents_that_are_all_different_need_no_merging(spark, sf_dir, monkeypatch):
    docs, queries = T.docs_text(spark, sf_dir), T.q_text(spark, sf_dir).limit(4)
    columns = ["query_id", "doc_key", "name", "type_alias", "score", "rank"]
    asked = RULES.with_(sort_by=(SortRule("n_chars"),))
    with monkeypatch.context() as patch:
        patch.setattr(PL, "all_different", lambda docs, queries: False)
        merged = [rows(PL.search(queries, docs, r).page, *columns) for r in (RULES, asked)]

    def meets(hits):
        raise AssertionError("all hits are sorted by node or key")

    monkeypatch.setattr(PL.ST, "merge_indexes_first_wins", meets)
    monkeypatch.setattr(PL.DD, "dedup_identity", meets)
    assert [rows(PL.search(queries, docs, r).page, *columns) for r in (RULES, asked)] == merged and merged[0]


def test_shared_nodes_keys_and_query_ids_are_noticed(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    docs = "node_id long, index_type string, doc_key string"
    assert PL.all_different(spark.createDataFrame([(1, "content", "a"), (1, "media", "b")], docs), queries)
    assert not PL.all_different(spark.createDataFrame([(1, "content", "a"), (1, "content", "b")], docs), queries)
    assert not PL.all_different(spark.createDataFrame([(1, "content", "a"), (2, "content", "A")], docs), queries)
    assert not PL.all_different(spark.createDataFrame([(None, "content", "a"), (None, "content", "b")], docs), queries)
    assert not PL.all_different(spark.createDataFrame([(1, "content", "a")], docs), queries.union(queries))


def test_curated_browse_ranks_the_hits_of_the_hot_query(spark, sf_dir):
    hot = all_queries()["curated_browse"](spark, sf_dir).filter(F.col("query_id") == T.HOT_QUERY)
    assert hot.count() == T.hits_orders(spark, sf_dir).filter(F.col("query_id") == T.HOT_QUERY).count() > 3


def test_tasks_keep_only_rows_that_a_window_may_take():
    """Equal scores are cut by key, near ones stay until they are rounded, whatever is held at a time."""
    import pyarrow as pa
    import random

    rng = random.Random(3)
    rows = [(q, "main", str(d), rng.choice([1.0, 2.0, 2.0000001, 3.5])) for d in range(4_000) for q in range(3)]
    names = ["query_id", "index_name", "doc_key", "weight"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[i : i + 500]]) for i in range(0, len(rows), 500)]
    first = lambda found, q: sorted((-round(r[3], 6), r[2]) for r in found if r[0] == q)[:7]
    for most in (700, 10**6):
        kept = [tuple(r.values()) for b in S._first_of(7, most)(batches) for r in b.to_pylist()]
        assert len(kept) < 200
        for q in range(3):
            assert first(kept, q) == first(rows, q)


def test_postings_of_frequent_terms_are_not_shuffled(spark, tables, monkeypatch):
    """Three documents hold 'red'; of more terms than may be broadcast, its postings stay where they are."""
    words, _, postings, stats = tables
    more = spark.createDataFrame([("i", "body", d, "red", 1, 4) for d in "gh"], postings.schema)
    postings = postings.unionByName(more)
    vocab = postings.groupBy("index_name", "field", "term").agg(F.count(F.lit(1)).alias("df"))
    given = words, lambda w: M.match_words(w, vocab, {"exact", "prefix"}, 0.8), postings, stats
    found = {}
    for most in (0, 5, 10**6):
        monkeypatch.setattr(S, "BROADCAST_TERMS", most)
        frame = S.score_bm25(*given)
        plan = frame._jdf.queryExecution().toString()
        found[most] = rows(frame, "query_id", "doc_key", "raw_score")
        assert ("SortMergeJoin" in plan) == (most < 10**6)
        assert most != 5 or "BroadcastHashJoin [index_name" in plan and "LeftAnti" in plan
    assert found[0] == found[5] == found[10**6] and {"g", "h"} <= {d for _, d, _ in found[0]}


def test_documents_meet_their_columns_before_their_queries(spark, sf_dir, monkeypatch):
    """No join, and so no shuffle, of the rows of queries and documents; the same hits as where the two are joined."""
    rules = RULES.with_(best_bets=(), fields=(FieldRule("bodyText", 2.0, "exact"), FieldRule("bodytext", 5.0, "prefix")))
    docs, queries = T.docs_text(spark, sf_dir), T.q_text(spark, sf_dir).limit(6)
    queries = queries.unionByName(T.query_defaults(spark.createDataFrame([(-1, " ", True)], "query_id long, term string, allow_empty boolean")))
    plans, keep = [], PL.store
    monkeypatch.setattr(PL, "store", lambda frame: plans.append((frame.columns, frame._jdf.queryExecution().toString().split("Physical Plan")[1])) or keep(frame))
    found = PL.search(queries, docs, rules, browse=False)
    plan = next(p for c, p in plans if "is_best_bet" in c)
    assert plan.index("MapInArrow") < plan.index("Join")
    both = [PL.search(queries, docs, rules, shared=s) for s in (False, True)]
    hits = [sorted(map(str, f.scored.drop("path", "fields").collect())) for f in both]
    assert hits[0] == hits[1] and len(hits[0]) > found.scored.count() > 0
    assert rows(both[0].stages["fetched"], "query_id", "doc_key", "raw_score") == rows(both[1].stages["fetched"], "query_id", "doc_key", "raw_score")
