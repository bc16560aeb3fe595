"""The language model: its base against counting, its score against a plain sum, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from llm.cases import awkward, empty

from findery.llm import maxent


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def out(doc_id):
    return zlib.crc32(str(doc_id if doc_id is not None else "").encode()) % 7 == 2


def test_base_and_gain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(awkward(spark).select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    counts = Counter(w for d, t in rows if not out(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        own = tokens(t)
        base = math.fsum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        want.append((d, out(d), len(own), sum(counts[w] > 0 for w in own), total, round(base, 6)))
    found = maxent.language_scores(docs, words=500).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in found)


def test_score_is_the_sum_over_words_and_probabilities_sum_to_one(spark):
    rows = [(i, " ".join(["a b", "c d e", "a c a f"][k] for k in np.random.default_rng(i).integers(0, 3, 6))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    model, table = maxent.train(docs, words=4, rounds=2, rate=0.5)
    counts = {bytes(r.word): r.n for r in table.collect()}
    place = maxent.places(model.joined)

    def log_next(before, word):
        ids = np.array([maxent.PAD, maxent.PAD, *model.ids(before), *model.ids([word])])
        at = maxent.features(ids)[:, -1:]
        logs = maxent.log_classes(model.weights, model.bias, at)[0]
        if word in place:
            return logs[model.classes[place[word]]] / math.log(10) + model.inside[place[word]]
        return logs[-1] / math.log(10) + math.log10((counts.get(word, 0) + 1) / (model.other_total + model.other_distinct + 1))

    every = [*counts, b"unknown"]
    spare = [c for c in range(maxent.CLASSES - 1) if c not in model.classes]
    for before in ([], [b"a"], [b"c", b"d"], [b"unknown", b"a"]):
        ids = np.array([maxent.PAD, maxent.PAD, *model.ids(before), 0])
        logs = maxent.log_classes(model.weights, model.bias, maxent.features(ids)[:, -1:])[0]
        assert abs(sum(10 ** log_next(before, w) for w in every) + np.exp(logs[spare]).sum() - 1) < 1e-5
    got = {r.doc_id: r.score for r in maxent.language_scores(docs, words=4).collect()}
    for doc_id, text in rows[:10]:
        own = [*text.encode().split(), maxent.END]
        assert abs(sum(log_next(own[:i], w) for i, w in enumerate(own)) - got[doc_id]) < 1e-3


def test_no_training_rows(spark):
    assert maxent.language_scores(empty(spark)).count() == 0
    only = next(i for i in range(50) if out(i))
    found = maxent.language_scores(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found] == [(3, 0, 0, 0.0)]
