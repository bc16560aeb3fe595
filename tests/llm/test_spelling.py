"""Spelling variants against comparing every two words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.cases import awkward, empty

from findery.llm.spelling import disjoint, near_pairs, spelling_forms

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, every=97, times=2):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % every == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [o for size in (len(w) - 1, len(w), len(w) + 1) for o in by_size.get(size, ()) if o != w and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()))


@pytest.mark.parametrize("every", [97, 5])
def test_equals_comparing_all_words(spark, sf_dir, every):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).repartition(3)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], every)
    assert got(spelling_forms(docs, every)) == want and any(w[1] for w in want)


def test_small_alphabets_have_repeated_grams_and_long_chains(spark):
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(500)} | {"a" * k for k in range(5, 30)}
    text = [w for i, w in enumerate(sorted(words)) for _ in range(3 + (2 ** (i % 9)))]
    rows = [(i, " ".join(text[i::7])) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert got(spelling_forms(docs)) == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_runs_of_one_letter(spark):
    """Grams that repeat side by side, where a pivot moves onto its own repeat."""
    words = {a * i + b * j + c * k for a, b, c in ("xyx", "xyz", "xxy", "yxx") for i in range(6) for j in range(6) for k in range(6)}
    text = " ".join(w for w in sorted(words) if len(w) >= 5 for _ in range(3))
    assert got(spelling_forms(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == plain([(1, text)])


def test_chain_of_forms(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)))]
    found = {r.word: r for r in spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"), every=10**9).collect()}
    assert {r.root for r in found.values()} == {"aabbbbb"} and found["aaaaaaa"].form == "aaaaaab"


def test_awkward_documents(spark):
    docs = awkward(spark)
    docs = docs.unionByName(docs).unionByName(docs)
    assert got(spelling_forms(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert spelling_forms(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "ab ab")], "doc_id long, text string")
    assert spelling_forms(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_forms(nothing).count() == 0


def test_dynamic_programming_finds_the_cheapest_disjoint_grams():
    rng = np.random.default_rng(2)
    for _ in range(200):
        places = sorted({int(p): int(c) for p, c in zip(rng.integers(0, 12, 6), rng.integers(1, 9, 6), strict=True)}.items())
        options = [(a[1] + b[1]) for i, a in enumerate(places) for b in places[i + 1:] if b[0] - a[0] >= 2]
        chosen = disjoint(places, 2)
        assert (sum(places[i][1] for i in chosen) == min(options)) if options else not chosen


def test_tables_of_words_are_not_broadcast(spark):
    """However small their files are: an explode above them makes many rows of each word."""
    words = ["house", "houses", "mouse", "river", "rivers"]
    docs = spark.createDataFrame([(i, " ".join(words)) for i in range(4)], "doc_id long, text string")
    vocab = spark.createDataFrame([(w, 4) for w in words], "word string, n long")
    for found in (near_pairs(vocab), spelling_forms(docs, every=10**9)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString() and found.count() > 2
