"""Brute-force and invariant checks on small frames."""

import random

import pytest
from pyspark.sql import Window, functions as F

from findery.operators import dedup as DD, extract as E, facets as FC, filters as FL, match as M, rank as R, score as S
from findery.operators.budget import admit_within_budget
from findery.operators.suggest import spell_correct
from findery.plans import search as PL
from findery.rules import Facet, FieldRule, RuleSet, SortRule
from findery.workload import tables as T


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("fuzziness", [0.8, 0.5])
def test_fuzzy_finds_every_near_term(spark, fuzziness):
    draw = random.Random(3)
    words = {"".join(draw.choices("abé", k=draw.randint(1, 12))) for _ in range(150)}
    vocab = spark.createDataFrame([("i", "f", w, 1) for w in words], "index_name string, field string, term string, df int")
    asked = [(n, 0, 0, w) for n, w in enumerate(sorted(words))]
    queries = spark.createDataFrame(asked, "query_id int, group_no int, variant_no int, variant string")
    got = {(r["variant"], r["term"]) for r in M.match_fuzzy(queries, vocab, fuzziness).collect()}
    limit = {w: min(2, int((1 - fuzziness) * len(w) + 1e-9)) for w in words}
    assert got == {(a, b) for a in words for b in words if edits(a, b) <= limit[a]}


def brute_admissions(events, n, width):
    out, state = {}, {}
    for event_id, caller, us in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        opened, used = state.get(caller, (None, 0))
        if opened is None or us >= opened + width:
            opened, used = us, 0
        out[event_id] = used < n
        state[caller] = (opened, used + 1)
    return out


@pytest.mark.parametrize("chunk, n", [(1, 2), (3, 2), (1440, 2), (2, 1), (4, 7)])
def test_budget_chunks_equal_one_pass(spark, chunk, n):
    draw = random.Random(chunk + n)
    # One caller holds most events; some share a timestamp, some leave gaps of many windows; a null caller is one.
    events, us = [], 0
    for i in range(600):
        us += draw.choice([0, 0, 1, 2, 3, 7, 10, 60]) * 1_000_000
        events.append((i, "hot" if draw.random() < 0.7 else draw.choice(["c1", "c2", None]), us))
    frame = spark.createDataFrame(events, "event_id int, caller string, us bigint").select(
        "event_id", F.lit("all").alias("stage"), "caller", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts")
    ).repartition(5)
    rows = admit_within_budget(frame, n, 10, windows_per_chunk=chunk).collect()
    want = brute_admissions([(i, c or "", u) for i, c, u in events], n, 10_000_000)
    assert {r["event_id"]: r["is_admitted"] for r in rows} == want


def test_budget_of_nothing(spark):
    none = spark.createDataFrame([], "event_id int, stage string, caller string, ts timestamp")
    assert admit_within_budget(none, 3).count() == 0 and admit_within_budget(none, 0).count() == 0


def test_scores_agree_whatever_join_runs(spark, sf_dir):
    docs, queries = T.docs_text(spark, sf_dir), T.q_text(spark, sf_dir)
    rules = RuleSet(fields=(FieldRule("bodytext", 1.0, "prefix"),), include_content_types=("src0",))
    index = PL.index_for(docs, rules)
    words = PL.query_words(queries, rules, index)
    matches = M.match_prefix(words, index.vocab).drop("match_mode", "variant")
    keys = ["query_id", "doc_key", "group_no", F.round("weight", 9).alias("w")]
    few = S.posting_matches(matches, index.postings, index.stats).select(*keys).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = S.posting_matches(matches, index.postings, index.stats).select(*keys).collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few and sorted(map(tuple, few)) == sorted(map(tuple, many))


def test_a_floor_does_not_empty_a_browse_listing(spark):
    hits = spark.createDataFrame([(1, 0.2, False), (2, 0.2, False), (2, 0.2, True), (2, 3.0, False)], "query_id int, score double, is_best_bet boolean")
    browsing = spark.createDataFrame([(1,)], "query_id int")
    kept = FL.filter_min_score(hits, 1.0, browsing).collect()
    assert sorted((r.query_id, r.score) for r in kept) == [(1, 0.2), (2, 0.2), (2, 3.0)]


def test_no_click_is_logged_when_logging_is_off(spark):
    from findery.sources.logs import LogSettings, clicks_to_log

    clicks = spark.createDataFrame([("k", "n", "name", 1)], "query_key string, node_key string, node_name string, position int")
    assert clicks_to_log(clicks, LogSettings(enabled=False)).count() == 0
    assert clicks_to_log(clicks).count() == 1


def test_no_window_fetches_every_row(spark):
    rows = spark.range(6000).selectExpr("1 AS query_id", "'i' AS index_name", "id AS doc_key", "CAST(id AS DOUBLE) AS raw_score")
    assert S.fetch_window(rows).count() == 6000 and S.fetch_window(rows, 5500).count() == 5500


def test_kept_index_gives_the_same_page(spark, sf_dir, tmp_path):
    from findery.operators.postings import build_postings, read_index

    docs, queries = T.docs_text(spark, sf_dir), T.q_text(spark, sf_dir)
    rules = RuleSet(fields=(FieldRule("bodytext"),), include_content_types=tuple(f"src{i}" for i in range(20)))
    build_postings(docs, ["bodytext"]).write(str(tmp_path))
    columns = ["query_id", "doc_key", "score", "rank"]
    kept = PL.search_batch(queries, docs, rules, index=read_index(spark, str(tmp_path))).select(*columns)
    fresh = PL.search_batch(queries, docs, rules).select(*columns)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, fresh.collect()))


def test_pages_partition_the_list(spark, sf_dir):
    ranked = R.rank_hits(T.hits_parts(spark, sf_dir))
    seen = []
    for page in range(1, 8):
        ids = ranked.select("query_id").distinct().withColumns({"term": F.lit("x"), "page": F.lit(page)})
        seen += R.page_slice(ranked, T.query_defaults(ids), 10)[0].select("query_id", "rank").collect()
    assert len(seen) == len(set(seen)) == ranked.count()


def test_dedup_twice_changes_nothing(spark, sf_dir):
    once = DD.dedup_by_field(T.hits_parts(spark, sf_dir), "name")
    assert DD.dedup_by_field(once, "name").count() == once.count()


def test_own_selection_leaves_own_counts(spark, sf_dir):
    hits = T.hits_parts(spark, sf_dir)
    facet = Facet("brand", "p_brand", max_values=1000)
    ids = hits.select("query_id").distinct()
    free = T.query_defaults(ids)
    chosen = T.query_defaults(ids.withColumn("filters", F.create_map(F.lit("Brand"), F.array(F.lit("brand#1")))))
    counts = [set(map(tuple, FC.facet_counts_excluding_self(hits, q, [facet]).collect())) for q in (free, chosen)]
    assert counts[0] == counts[1]


def test_json_walk(spark):
    long = "these are six words of prose"
    nested = '{"body": "%s", "label": "seven words that are only a label"}' % (long + " nested")
    text = (
        '{"layout": {"a": "%s"}, "contentData": [{"contentTypeKey": "k", "heading": "%s", "text": "<p>%s</p>",'
        ' "rows": {"name": {"text": "%s again"}}, "inner": %s}], "short": "too few words"}'
        % (long, long, long, long, __import__("json").dumps(nested))
    )
    rows = spark.createDataFrame([(text,), ("{not json but prose of many words",), ("[]",)], "v string")
    got = [r["texts"] for r in E.extract_json_text(rows, "v").collect()]
    assert got == [[long, long + " again", long + " nested"], ["{not json but prose of many words"], []]


def test_spelling(spark):
    queries = spark.createDataFrame([(1, "prodct serch"), (2, "product")], "query_id int, term string")
    totals = spark.createDataFrame([(1, 3), (2, 0)], "query_id int, total int")
    words = [(1, "Search", 0), (1, "product", 1), (1, "products", 2), (2, "Product", 0)]
    vocabulary = spark.createDataFrame(words, "query_id int, word string, place int")
    assert [tuple(r) for r in spell_correct(queries, totals, vocabulary).collect()] == [(1, "product Search")]


def test_rerank_is_a_permutation(spark, sf_dir):
    page = R.rank_hits(T.hits_parts(spark, sf_dir)).filter("rank <= 30")
    ranked = R.apply_rerank(page, T.rerank_replies(spark, sf_dir))
    key = lambda f: sorted((r["query_id"], r["rank"]) for r in f.select("query_id", "rank").collect())
    assert key(page) == key(ranked) and page.select("doc_key").exceptAll(ranked.select("doc_key")).count() == 0


def test_numbering_splits_a_query_that_holds_most_hits(spark, tmp_path):
    """One query's hits are numbered by several tasks, and as a window over all of them would."""
    from findery.session import settings

    hits = spark.range(0, 30_000, 1, 4).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 70).otherwise(5).alias("query_id"), F.col("id").cast("string").alias("doc_key"),
        F.lit(0).alias("index_rank"), (F.col("id") % 3 == 0).alias("is_best_bet"), (F.col("id") % 100).cast("double").alias("score"),
        F.lit(0.0).alias("raw_score"), F.create_map(F.lit("size"), (F.col("id") % 7).cast("string")).alias("fields"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("is_best_bet"), F.desc("score"), "doc_key")
    again = Window.partitionBy("query_id").orderBy(F.desc("is_best_bet"), F.desc(F.expr("cast(fields['size'] as int)")), "rank")
    with settings(spark, {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        ranked = R.rank_hits(hits)
        resorted = R.sort_multi(ranked, [SortRule("size", "descending")])
        expected = hits.withColumn("rank", F.row_number().over(order))
        for found, wanted in ((ranked, expected), (resorted, expected.withColumn("rank", F.row_number().over(again)))):
            rows = found.select("doc_key", "query_id", "rank", F.spark_partition_id().alias("task")).collect()
            assert len({r.task for r in rows if r.query_id == 5}) > 2
            assert sorted(r[:3] for r in rows) == sorted(tuple(r) for r in wanted.select("doc_key", "query_id", "rank").collect())


def _site(spark):
    """Documents with a text in two fields, one of 700 different words, one without a word, and one whose fields differ."""
    long = " ".join(f"w{i}" for i in range(700)) + " w1 W1"
    rows = [
        ("1", "a name", {"bodytext": "Ünder, the-tree  THE", "bodytext_en": "Ünder, the-tree  THE"}),
        ("2", "tree", {"bodytext": long, "bodytext_fr": long}),
        ("3", "", {"bodytext": " .,- "}), ("4", None, {"bodytext": "tree w1", "bodytext_en": "other tree"}), ("5", "five", {}),
    ]
    docs = spark.createDataFrame(rows, "doc_key string, name string, fields map<string,string>")
    return docs.selectExpr("'main' AS index_name", "'content' AS index_type", "'page' AS type_alias", "*")


def _plain_postings(spark):
    import re
    from collections import Counter

    rows = []
    for r in _site(spark).collect():
        for field, value in {"nodename": r.name, **r.fields}.items():
            words = [w for w in re.split(r"[\W_]+", (value or "").lower()) if w]
            rows += [(field, r.doc_key, term, tf, len(words)) for term, tf in Counter(words).items()]
    return sorted(rows)


def test_a_text_of_several_fields_is_cut_once_and_its_vocabulary_needs_no_postings(spark):
    from collections import Counter

    from findery.operators.postings import PIECE, build_postings

    index, plain = build_postings(_site(spark), ["nodename", "bodytext"]), _plain_postings(spark)
    packed = {(r.doc_key, tuple(sorted(r.fields))): 0 for r in index.counted.collect()}
    assert ("1", ("bodytext", "bodytext_en")) in packed and ("4", ("bodytext",)) in packed and len(packed) == 7
    assert max(len(r.terms) for r in index.counted.collect()) == PIECE
    df = Counter((f, t) for f, _, t, _, _ in plain)
    lengths = {(f, k): n for f, k, _, _, n in plain}
    for kept in (index, index.stored(), index.stored(False)):
        assert sorted(map(tuple, kept.postings.select("field", "doc_key", "term", "tf", "doc_len").collect())) == plain
        firsts = sorted(map(tuple, kept.postings.filter("is_first").select("field", "doc_key").collect()))
        assert firsts == sorted(lengths)
        assert {(r.field, r.term): r.df for r in kept.vocab.collect()} == df
        asked = spark.createDataFrame([("tree",), ("w1",), ("none",)], "term string")
        some = {(r.field, r.term): r.df for r in kept.vocab_of(asked).collect()}
        assert some == {k: n for k, n in df.items() if k[1] in ("tree", "w1")}
        for r in kept.stats.collect():
            own = [n for (f, _), n in lengths.items() if f == r.field]
            assert (r.n_docs, r.avg_len) == (len(own), sum(own) / len(own))
    counting = index.vocab_of(asked)._jdf.queryExecution().executedPlan().toString()
    assert "doc_len" not in counting


def test_a_word_of_one_key_meets_a_term_once_without_gathering_pairs(spark):
    from findery.operators import match as M

    vocab = spark.createDataFrame([("main", "body", t, 1) for t in ("aaaaaa", "banana", "ban", "an")], "index_name string, field string, term string, df long")
    words = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "An"), (2, 0, 0, "aaa"), (3, 0, 0, "ana")], "query_id int, group_no int, variant_no int, variant string")
    for match, test in ((M.match_wildcard, str.__contains__), (M.match_prefix, str.startswith)):
        found = match(words, vocab)
        assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.query_id, r.variant, r.term) for r in found.collect())
        assert got == sorted(
            (q, w, t) for q, w in ((1, "a"), (1, "An"), (2, "aaa"), (3, "ana")) for t in ("aaaaaa", "banana", "ban", "an") if test(t, w.lower()))
