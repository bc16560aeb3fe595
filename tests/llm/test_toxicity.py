"""The factorization machine: its gradient, held-out accuracy, and awkward input."""

import numpy as np
from llm.cases import awkward, empty
from pyspark.sql import functions as F

from findery.llm import toxicity


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    rows, labels = [np.array([0, 2, 3]), np.array([], int), np.array([1, 3])], np.array([1, 0, 1])
    state = rng.normal(size=1 + 4 + 8)

    def loss(s):
        _, logit, _ = toxicity.forward(s[0], s[1:5], s[5:].reshape(4, 2), rows)
        return np.sum(np.log1p(np.exp(logit)) - labels * logit)

    slope = toxicity.gradient(state[0], state[1:5], state[5:].reshape(4, 2), rows, labels)[:-1]
    for i in range(len(state)):
        step = np.zeros_like(state)
        step[i] = 1e-6
        assert abs((loss(state + step) - loss(state - step)) / 2e-6 - slope[i]) < 1e-4


def test_a_pair_can_mean_what_its_terms_do_not(spark):
    """Toxic is 'dumb' or 'folk' with the other one only."""
    rows, labels = [], []
    for i in range(600):
        words = [w for w, bit in (("dumb", i & 1), ("folk", i & 2), ("tree", i & 4)) if bit]
        rows.append((i, " ".join(words)))
        labels.append((i, int("dumb" in words and "folk" in words)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, marks).join(marks, "doc_id").where("held_out")
    assert found.where("predicted <> toxic").count() == 0 and found.count() > 100


def held_out_mistakes(spark, bits, toxic):
    """Of 1,600 rows whose words are given by their number."""
    rows = [(i, " ".join(w for w, on in bits.items() if on(i))) for i in range(1600)]
    labels = [(i, int(toxic(set(text.split())))) for i, text in rows]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.toxicity(docs, marks).join(marks, "doc_id").where("held_out")
    assert found.count() > 200
    return found.where("predicted <> toxic").count()


def test_a_pair_with_a_neutral_term(spark):
    """'folk' is in half of the toxic rows and in half of all; 'dumb' is toxic with it only, and 'slur' always."""
    bits = {"dumb": lambda i: i % 8 in (0, 1), "folk": lambda i: i % 2, "slur": lambda i: i % 8 == 2, "tree": lambda i: i // 8 % 2}
    assert held_out_mistakes(spark, bits, lambda words: "slur" in words or {"dumb", "folk"} <= words) == 0


def test_a_pair_with_an_excusing_term(spark):
    """'dumb' is toxic, but not with 'joke', which alone is rather clean."""
    bits = {"dumb": lambda i: i % 4 == 0, "joke": lambda i: i // 4 % 2, "tree": lambda i: i // 8 % 2}
    assert held_out_mistakes(spark, bits, lambda words: "dumb" in words and "joke" not in words) == 0


def test_a_pair_of_neutral_terms(spark):
    """Toxic with exactly one of two words, of which each is as often in toxic rows as in others."""
    draw = np.random.default_rng(1)
    noise = [{f"w{k}" for k in draw.integers(0, 40, 12)} for _ in range(1600)]
    one, two = draw.random(1600) < 0.5, draw.random(1600) < 0.5
    bits = {"alpha": lambda i: one[i], "beta": lambda i: two[i], **{f"w{k}": (lambda i, w=f"w{k}": w in noise[i]) for k in range(40)}}
    assert held_out_mistakes(spark, bits, lambda words: ("alpha" in words) != ("beta" in words)) == 0


def test_score_is_the_plain_sum_over_pairs():
    draw = np.random.default_rng(3)
    words = [b"one", b"two", b"three", b"longer", b"longest"]
    terms = np.array(sorted({f for w in words for f in toxicity.word_features(w)}))
    model = toxicity.Model(terms, -0.3, draw.normal(size=len(terms)), draw.normal(size=(len(terms), 3)))
    texts = ["one two", "Three, longer longer LONGEST! unknown", "", "one two three longest"]
    got = model.score(model.features(texts))
    for text, score in zip(texts, got, strict=True):
        own = sorted({int(np.searchsorted(terms, f)) for w in text.encode().lower().split() for f in toxicity.word_features(w) if f in terms})
        logit = -0.3 + sum(model.weights[i] for i in own) + sum(model.factors[i] @ model.factors[j] for i in own for j in own if i < j)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts.get((1, 0), 0)), counts
    assert counts.get((0, 1), 0) <= 0.01 * counts[0, 0], counts


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (12, 0), (None, 1), (8, None), (99, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(docs, labels)
    assert found.count() == docs.count() and found.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    none = toxicity.toxicity(docs, labels.where("false"))
    assert none.where(F.col("predicted") == 1).count() == 0
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_every_labelled_row_trains(spark):
    """24,000 labelled rows, more than any earlier bound: all that are not held out are counted."""
    docs = spark.range(24_000).selectExpr("id AS doc_id", "concat('word', id % 40, ' other', id % 3) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 40 < 4 AS int) AS toxic")
    wanted = docs.where(toxicity.fold(docs.doc_id) != 2)
    whole = toxicity.tallied(toxicity.cut(toxicity.labelled(docs, labels)), None).where("term = -1").first()
    assert (whole.n, whole.a) == (wanted.count(), wanted.where("doc_id % 40 < 4").count())


def test_texts_without_a_label_stay_where_they_are(spark):
    """Of 20,000 rows, ids of both signs, all 300 labelled ones and hardly another one go on to meet their labels."""
    docs = spark.range(-10_000, 10_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionByName(spark.createDataFrame([(None, "text")], "doc_id long, text string"))
    known = spark.range(-150, 150)
    found = {r.doc_id for r in toxicity.maybe_among(docs, known).collect()}
    assert found >= set(range(-150, 150)) and len(found) < 310
    assert toxicity.maybe_among(docs, known.where("false")).count() == 0
    labels = known.selectExpr("id AS doc_id", "cast(id % 2 = 0 AS int) AS toxic")
    rows = toxicity.labelled(docs, labels).collect()
    assert len(rows) == known.where(toxicity.fold(known.id) != 2).count()
    assert all(r.label == (int(r.text.split()[1]) % 2 == 0) for r in rows)


def test_counts_of_a_large_table(spark):
    """Of 2,000,000 rows, for which a product of four counts is beyond a long: the chi-square of plain integers, to the last bit."""
    n, bad = 2_000_000, 300_000
    seen = {3: (1_000_000, 200_000), 5: (900_000, 100_000), 7: (3, 3), 9: (2_000_000, 300_000)}
    counts = spark.createDataFrame([(-1, n, bad), *((t, *x) for t, x in seen.items())], "term int, n long, a long")
    found = {r.term: (r.score, r.toxic) for r in toxicity.telling(counts, 10, 0.0)}
    for t, (k, a) in list(seen.items())[:3]:
        share = a * n - k * bad
        assert found[t] == (n * float(share) * share / float(k * bad * (n - k) * (n - bad)), share > 0)
    assert 9 not in found
