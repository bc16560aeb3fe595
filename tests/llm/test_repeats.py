"""Repeated passages against counting every window."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from llm.cases import SCHEMA, awkward, empty

from findery.llm.repeats import remove_repeats, super_kmers, word_hashes


def plain(rows, width):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    places = Counter(tuple(w[s:s + width]) for w in cut for s in range(len(w) - width + 1))
    out = []
    for (doc_id, _), words in zip(rows, cut, strict=True):
        gone = set()
        for s in range(len(words) - width + 1):
            if places[tuple(words[s:s + width])] > 1:
                gone.update(range(s, s + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("crowd", [2_000, 1])
def test_equals_counting_windows(spark, sf_dir, crowd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert sum(w[2] for w in want) > 0
    assert got(remove_repeats(docs, crowd=crowd)) == want


@pytest.mark.parametrize("crowd", [2_000, 3])
def test_small_alphabets_overlap_and_repeat_within_a_text(spark, crowd):
    rng = np.random.default_rng(crowd)
    rows = [(i, " ".join(rng.choice(list("ab"), rng.integers(0, 60)).tolist())) for i in range(60)]
    rows += [(100, "x y " * 40), (101, "q " * 200), (102, "x y " * 40 + "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(remove_repeats(docs, width=12, gram=4, crowd=crowd)) == plain(rows, 12)


def test_awkward_documents(spark):
    docs = awkward(spark)
    want = plain([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert got(remove_repeats(docs)) == want
    assert got(remove_repeats(docs, width=10, gram=3)) == plain([(r.doc_id, r.text) for r in docs.collect()], 10)


def test_a_passage_of_many_documents(spark):
    """Only the passage goes: what stands around it is every document's own."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(i % 7 * 10))} {passage}\n{' '.join(f'b{i}x{k}' for k in range(20))}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for crowd in (2_000, 10):
        found = remove_repeats(docs, crowd=crowd)
        assert {r.n_removed for r in found.collect()} == {50} and got(found) == plain(rows, 35)


def test_empty_table(spark):
    assert remove_repeats(empty(spark)).count() == 0
    assert got(remove_repeats(spark.createDataFrame([(1,) + (None,) * 7], SCHEMA))) == plain([(1, None)], 35)


def test_blocks_and_long_words_change_no_hash(monkeypatch):
    words = [f"w{i % 50}" for i in range(500)] + ["x" * 5_000] + ["é"] * 20
    data = " \n".join(words).encode()
    whole = word_hashes(data)
    assert len(whole) == len(words) and len(set(whole.tolist())) == 52
    from findery.llm import repeats
    monkeypatch.setattr(repeats, "BLOCK", 64)
    assert (word_hashes(data) == whole).all()


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 5, 40, 35, 200, 34])
    words = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
    docs, _, starts, counts = super_kmers(words, sizes, 35, 8)
    covered = sorted((d, s + i) for d, s, c in zip(docs, starts, counts, strict=True) for i in range(c))
    assert covered == [(d, s) for d in range(6) for s in range(max(0, sizes[d] - 34))]
    assert counts.max() <= 28
