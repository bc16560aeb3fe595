"""Decontamination: planted passages and paraphrases, recall against brute force, and awkward input."""

import random

import numpy as np
import pytest
from llm.cases import awkward, empty

from findery.llm import decontaminate


def plain_lcs(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    return table[-1, -1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 70))] for _ in range(2))
        assert decontaminate.Item(1, a, []).lcs(b) == plain_lcs(a, b)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")


def test_every_verbatim_passage_is_found(spark, benchmark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for i, t in items.items() if r.text and t in r.text}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert want and len(want & got) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)


def test_paraphrases(spark, benchmark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, items = random.Random(4), benchmark.collect()
    hosts = [r.text.split() for r in docs.limit(200).collect()]
    rows = []
    for item in items:
        words = item.text.split()
        for at in rng.sample(range(len(words)), len(words) // 7):
            words[at] = f"other{rng.randrange(50)}"
        host = rng.choice(hosts)[:400]
        rows.append((item.item_id, " ".join([*host[: len(host) // 2], *words, *host[len(host) // 2 :]])))
    given = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(given, benchmark).where("doc_id < 100000").collect()}
    assert len({(i, i) for i, _ in rows} & got) >= 0.9 * len(rows)


def test_paraphrases_that_a_third_of_all_rows_hold(spark, benchmark):
    """What the paraphrase kept is then common, and only what it replaced is rare."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng, items = random.Random(6), benchmark.orderBy("item_id").limit(20).collect()
    passage = []
    for item in items:
        words = item.text.split()
        for at in rng.sample(range(len(words)), len(words) // 7):
            words[at] = f"other{rng.randrange(50)}"
        passage += words
    hot = [(i, f"{i} {' '.join(passage)} {i}") for i in range(docs.count() // 2)]
    given = spark.createDataFrame(hot, "doc_id long, text string").unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(given, benchmark).where("doc_id < 100000").collect()}
    by_item = {item.item_id: sum(i == item.item_id for _, i in got) for item in items}
    # An item whose answer was changed and that keeps too few words for `sure` is no leak.
    assert sum(n == len(hot) for n in by_item.values()) >= 0.9 * len(items), by_item


def test_full_search_leaves_nothing_out():
    rng, vocabulary = random.Random(8), [b"w%d" % i for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((12, 60))]).decode() for _ in range(rng.randint(0, 300))) for _ in range(60)]
    given = [" ".join(t.split()[a : a + n]) for t in texts[:40] for a, n in [(rng.randint(0, 50), rng.randint(1, 40))] if t.split()[a : a + n]]
    rows, own = decontaminate.term_rows(texts), decontaminate.term_rows(given)
    items = [decontaminate.Item(i, row[:, 0].tolist(), []) for i, row in enumerate(own)]
    rates = np.bincount(np.concatenate(rows)[:, 1], minlength=decontaminate.TERMS) / sum(map(len, rows))
    want = set()
    for k, row in enumerate(rows):
        for item in items:
            n = len(item.words)
            for start in range(0, len(row), max(1, n // 2)):
                region = row[max(0, start - n // 2) : start + n + n // 2, 0].tolist()
                if item.lcs(region) >= 0.6 * n:
                    want.add((k, item.item_id, start))
    got = {(k, item.item_id, start) for k, item, start in decontaminate.FullSearch(items, own, rates, 0.6).regions(rows)}
    assert want and want <= got


def test_awkward_rows(spark):
    items = spark.createDataFrame(
        [(1, "One two three four five six seven eight nine ten."), (2, None), (3, ""), (None, "a null id"), (1, "the of")],
        "item_id long, text string",
    )
    docs = awkward(spark)
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(5, 1), (10, 1), (None, None)}
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {7, 8, 9, 11, 12, -3}
    assert decontaminate.leaks(docs, items.where("false")).count() == 0
    assert decontaminate.decontaminated(docs, items.where("false")).count() == docs.count()
    assert decontaminate.leaks(empty(spark), items).count() == 0


def test_words_are_cut_like_plain_ones():
    """The same words, and different words apart, whatever the blocks."""
    given = ["Hello, WORLD! (foo) -- don't \x0b\t é… ÉÉ", "", " \n", "a" * 3000 + ", ...x...", "hello world foo DON'T É… ÉÉ", "\x1cx y\x85z"]
    plain = [[w.strip(decontaminate.EDGES) for w in t.encode().lower().split()] for t in given]
    rows = decontaminate.term_rows(given)
    words = [[w for w in own if w] for own in plain]
    assert [len(r) for r in rows] == [len(w) for w in words]
    ids = {}
    for own, row in zip(words, rows, strict=True):
        for w, (identity, term) in zip(own, row.tolist(), strict=True):
            assert ids.setdefault(w, (identity, term)) == (identity, term) and term < decontaminate.TERMS
    assert len({i for i, _ in ids.values()}) == len(ids)


def test_the_basis_is_fitted_on_every_passage(spark):
    """The summed product equals that of one matrix with a row for each passage of each text, none left out."""
    texts = [" ".join(f"w{(i * 7 + j * j) % 90}" for j in range(i % 130)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = decontaminate.cut(docs)
    total, _, counts = decontaminate.document_frequencies(kept)
    idf = decontaminate.weights(total, counts, 0.9)
    rows = []
    for row in decontaminate.term_rows(texts):
        for at in range(0, len(row), 40):
            line = np.bincount(row[at : at + 40, 1], minlength=decontaminate.TERMS) * idf
            if line.any():
                rows.append(line / np.linalg.norm(line))
    matrix = np.array(rows)
    basis = np.random.default_rng(3).normal(size=(decontaminate.TERMS, 4)).astype(np.float32)
    got = decontaminate.summed(kept, idf, 40, basis)
    assert total == 300 and np.allclose(got, matrix.T @ (matrix @ basis), rtol=1e-3, atol=1e-2)


def test_texts_beyond_any_sample_shape_the_basis(spark):
    """Two words stand for each other in one text of 6,000 alone."""
    rows = [(i, f"filler{i % 50} common{i % 7}") for i in range(6_000)] + [(6_000, "rareone raretwo")]
    items = spark.createDataFrame([(1, "unrelated words here")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    space = decontaminate.fit(decontaminate.cut(docs), items, 70, 40, 0.9, 0)
    one, two = space.vectors[decontaminate.term_rows(["rareone raretwo"])[0][:, 1]]
    assert one @ two > 0.9 * np.linalg.norm(one) * np.linalg.norm(two) > 0
