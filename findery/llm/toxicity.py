"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashes of its distinct words and of their first four and five characters.
score = sigmoid(bias + sum of weights + sum over pairs of features of the dot product of their factors),
so that two terms can mean more together than apart.

Every labelled row that is not held out trains the model. Its texts are cut into features once, which are kept for all later
steps. The model's terms are chosen from counts over all of these rows: those that tell the labels apart beyond chance, for or against toxicity, over all rows or
among the rows with a term that goes with toxic ones, or in pairs that say what neither term does alone, so that neutral and
excusing sides of a pair are there to be learned. At most `terms` of them make the model, so its size is fixed. Every round is one Spark job over all of them: each core sums the gradient of its
rows, and the driver, which only holds the model, takes one step. Scoring reads every text once, with no shuffle.

A null text is an empty one and scores the bias; a null doc_id is in no fold; repeated rows are scored
alike; a doc_id labelled twice is toxic if one label says so; labels of no document, null labels and other
columns are ignored. Texts of any length are scored whole, each distinct term once; terms of equal strength are taken in the order of
their hashes. Without any labelled row every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import Memo, texts
from findery.session import store

SPACE = 1 << 24
#: Features that are counted at once.
TOGETHER = 4_000_000
#: Bits that tell which ids may be labelled: 8 MB, however many labels there are.
MARKS = 1 << 26
#: Trimmed from both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>|*_-"


def word_features(word: bytes) -> list[int]:
    core = word.strip(EDGES)
    if not core:
        return []
    chars = core.decode("utf-8", "replace")
    parts = [core, *(b"%d:%s" % (n, chars[:n].encode()) for n in (4, 5) if len(chars) > n)]
    return [zlib.crc32(p) % SPACE for p in parts]


@dataclass
class Model:
    terms: np.ndarray  # sorted feature hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    memo: Memo = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self.place = {int(t): i for i, t in enumerate(self.terms)}
        self.memo = Memo(lambda words: [self._known(w) for w in words])

    def __reduce__(self):
        return Model, (self.terms, self.bias, self.weights, self.factors)

    def _known(self, word: bytes) -> bytes:
        return np.array([self.place[f] for f in word_features(word) if f in self.place], "<i4").tobytes()

    def features(self, many: list[str]) -> list[np.ndarray]:
        found = self.memo.lookup([t.encode().lower().split() for t in many])
        return [np.unique(np.frombuffer(b"".join(x), "<i4")) for x in found]

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        _, logit, _ = forward(self.bias, self.weights, self.factors, rows)
        return 1 / (1 + np.exp(-logit))


def end_to_end(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(features a row, all features)."""
    return np.array([len(r) for r in rows], int), np.concatenate(rows) if rows else np.zeros(0, int)


def forward(bias: float, weights: np.ndarray, factors: np.ndarray, rows: list[np.ndarray] | tuple[np.ndarray, np.ndarray]):
    """The rows' features end to end with their row numbers, logits, and summed factors."""
    sizes, flat = rows if isinstance(rows, tuple) else end_to_end(rows)
    n = len(sizes)
    at = np.repeat(np.arange(n), sizes)
    linear = np.bincount(at, weights[flat], n)
    sums = np.stack([np.bincount(at, factors[flat, f], n) for f in range(factors.shape[1])], axis=1)
    squares = np.bincount(at, (factors[flat] ** 2).sum(1), n)
    logit = bias + linear + 0.5 * ((sums**2).sum(1) - squares)
    return (at, flat), np.clip(logit, -50, 50), sums


def gradient(bias, weights, factors, rows, labels) -> np.ndarray:
    """Of the summed log loss: bias, weights, factors and, last, the number of rows."""
    (at, flat), logit, sums = forward(bias, weights, factors, rows)
    off = 1 / (1 + np.exp(-logit)) - labels
    each, size = off[at], len(weights)
    by_factor = [np.bincount(flat, each * (sums[at, f] - factors[flat, f]), size) for f in range(factors.shape[1])]
    return np.concatenate([[off.sum()], np.bincount(flat, each, size), np.stack(by_factor, axis=1).ravel(), [len(labels)]])


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among the ids, and by chance a few others: ids are marked in a broadcast bitmap of fixed size."""

    def bit(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(MARKS))

    marks = ids.select(bit(F.col("id")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit(F.col("doc_id")))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, (place % 8).cast("int")) == 1
    return rows.join(F.broadcast(marks), (F.bitmap_bucket_number(bit(F.col("doc_id"))) == F.col("bucket")) & found, "left_semi")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of every labelled row that is not held out. Other rows' texts are left out before any shuffle."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("id")) != 2))
    known = marks.groupBy("id").agg(F.max("toxic").alias("label"))
    rows = maybe_among(texts(docs), known.select("id"))
    return rows.join(known, F.col("doc_id") == F.col("id")).select("text", "label")


def cut(rows: DataFrame) -> DataFrame:
    """(features, label): the sorted hashes of each text's features, four bytes each, written once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda words: [np.array(word_features(w), "<i4").tobytes() for w in words])
        for batch in batches:
            found = memo.lookup([list(set(t.encode().lower().split())) for t in batch.column("text").to_pylist()])
            held = [np.unique(np.frombuffer(b"".join(x), "<i4")).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), batch.column("label")], ["features", "label"])

    return store(rows.mapInArrow(run, "features binary, label int"))


def row_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(features a row, all features) of what `cut` kept."""
    held = batch.column("features").to_pylist()
    return np.array([len(x) // 4 for x in held], int), np.frombuffer(b"".join(held), "<i4")


def tallied(sample: DataFrame, within: np.ndarray | None) -> DataFrame:
    """(term, n, a): rows and toxic rows by feature hash, and of all under -1; only of rows that have a feature of `within`."""

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, at = np.unique(np.concatenate([h for h, _ in parts]), return_inverse=True)
        toxic = np.bincount(at, np.concatenate([t for _, t in parts]), len(hashes))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes, pa.int32()), pa.array(np.bincount(at, minlength=len(hashes)), pa.int64()), pa.array(toxic.astype("i8"))],
            ["term", "n", "toxic"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            sizes, flat = row_features(batch)
            labels, at = batch.column("label").to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
            wanted = np.ones(len(sizes), bool)
            if within is not None:
                wanted = np.bincount(at, np.isin(flat, within), len(sizes)) > 0
            parts += [(flat[wanted[at]], labels[at][wanted[at]]), (np.full(wanted.sum(), -1, "<i4"), labels[wanted])]
            held += len(parts[-2][0])
            if held >= TOGETHER:
                yield counted(parts)
                parts, held = [], 0
        if parts:
            yield counted(parts)

    counts = sample.mapInArrow(run, "term int, n long, toxic long")
    return store(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("a")))


def telling(counts: DataFrame, terms: int, least: float) -> list:
    """(term, score, toxic): the strongest `terms` whose chi-square over the labels is at least `least`, and
    whether they go with toxic rows."""
    whole = counts.where("term = -1").first()
    if whole is None:
        return []
    seen = counts.where("term >= 0 and n >= 3").withColumns({"rows": F.lit(whole.n).cast("long"), "bad": F.lit(whole.a).cast("long")})
    share = F.col("a") * F.col("rows") - F.col("n") * F.col("bad")
    # A product of four counts passes a long's range from some 100,000 rows on; two are exact, and their product rounded once.
    spread = (F.col("n") * (F.col("rows") - F.col("n"))).cast("double") * (F.col("bad") * (F.col("rows") - F.col("bad"))).cast("double")
    score = F.when(spread > 0, F.col("rows") * share.cast("double") * share / spread)
    best = seen.select("term", score.alias("score"), (share > 0).alias("toxic")).where(F.col("score") >= least)
    return best.orderBy(F.desc("score"), "term").limit(terms).collect()


def places(flat: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which features are among the sorted terms, and where those stand there)."""
    if not len(terms):
        return np.zeros(len(flat), bool), np.zeros(0, int)
    at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    real = terms[at] == flat
    return real, at[real]


def by_core(rows: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores at most, so that sums of a model's size do not grow with the data."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def telling_pairs(sample: DataFrame, often: np.ndarray, rate: float, least: float, rows: int = 20) -> np.ndarray:
    """Of the sorted hashes `often`, those with a partner among them such that rows with both are more or less toxic than each
    of the two alone lets expect, by at least `least` standard errors.

    Each core adds up two matrices of `often` squared, however many rows there are.
    """
    size = len(often)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, off = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
        for batch in batches:
            sizes, flat = row_features(batch)
            real, place = places(flat, often)
            held = np.zeros((len(sizes), size), np.float32)
            held[np.repeat(np.arange(len(sizes)), sizes)[real], place] = 1
            both += held.T @ held
            off += held.T @ (held * (batch.column("label").to_numpy() - rate).astype(np.float32)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary()), pa.array([off.tobytes()], pa.binary())], ["both", "off"])

    def strong(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, off = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            for r in batch.to_pylist():
                both += np.frombuffer(r["both"], "f4").reshape(size, size)
                off += np.frombuffer(r["off"], "f4").reshape(size, size)
        alone = np.diag(off) / np.maximum(np.diag(both), 1)
        gap = off / np.maximum(both, 1) - alone[:, None] - alone[None]
        found = (both >= rows) & (np.abs(gap) * np.sqrt(both) >= least * math.sqrt(rate * (1 - rate)))
        yield pa.RecordBatch.from_arrays([pa.array(often[found.any(1)], pa.int32())], ["term"])

    # A pair of matrices a core meets in one task; the driver gets the terms.
    sums = by_core(sample).mapInArrow(run, "both binary, off binary")
    found = sums.repartition(1).mapInArrow(strong, "term int").collect()
    return np.array(sorted(r.term for r in found), "<i4")


def chosen_terms(sample: DataFrame, terms: int, least: float, often: int, errors: float) -> np.ndarray:
    """Feature hashes that tell the labels apart, alone, among rows that have one that goes with toxic rows, or as one of a
    pair of the `often` most frequent ones that says what neither does alone; the strongest `terms` of them."""
    counts = tallied(sample, None)
    alone = telling(counts, terms, least)
    toxic = np.array([r.term for r in alone if r.toxic], "<i4")
    beside = telling(tallied(sample, toxic), terms, least) if len(toxic) else []
    best: dict[int, float] = {}
    for r in [*alone, *beside]:
        best[r.term] = max(r.score, best.get(r.term, 0.0))
    whole = counts.where("term = -1").first()
    if whole is not None and 0 < whole.a < whole.n:
        common = [r.term for r in counts.where("term >= 0 and n >= 3").orderBy(F.desc("n"), "term").limit(often).collect()]
        for t in telling_pairs(sample, np.array(sorted(common), "<i4"), whole.a / whole.n, errors).tolist():
            best.setdefault(t, least)
    return np.array(sorted(sorted(best, key=lambda t: (-best[t], t))[:terms]), "i8")


def train(
    docs: DataFrame, labels: DataFrame, terms: int = 8_192, factors: int = 4, rounds: int = 40,
    rate: float = 0.1, decay: float = 1e-4, least: float = 25.0, often: int = 1_024, errors: float = 6.0, seed: int = 7,
) -> Model:
    """A model of all labelled rows that are not held out."""
    sample = cut(labelled(docs, labels))
    picked = chosen_terms(sample, terms, least, often, errors)
    rng = np.random.default_rng(seed)
    blank = Model(picked, 0.0, np.zeros(len(picked)), rng.normal(0, 0.05, (len(picked), factors)))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = row_features(batch)
            real, place = places(flat, picked)
            kept = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
            ends = pa.array(np.cumsum([0, *kept]), pa.int32())
            at = pa.ListArray.from_arrays(ends, pa.array(place, pa.int32()))
            yield pa.RecordBatch.from_arrays([at, batch.column("label")], ["at", "label"])

    data = store(sample.mapInArrow(features, "at array<int>, label int"))
    # The rows' share of toxic ones starts the bias.
    n, bad = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return Model(picked, -50.0, blank.weights, blank.factors)
    state = np.concatenate([[np.log((bad + 1) / (n - bad + 1))], blank.weights, blank.factors.ravel()])
    first, second, size = np.zeros_like(state), np.zeros_like(state), len(picked)
    for step in range(1, rounds + 1):
        now = state.copy()

        def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(now) + 1)
            for batch in batches:
                at = batch.column("at")
                found = at.value_lengths().to_numpy(), at.flatten().to_numpy()
                total += gradient(now[0], now[1 : size + 1], now[size + 1 :].reshape(size, factors), found, batch.column("label").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        # A row a core, each of the model's size.
        total = sum(np.frombuffer(r.total) for r in by_core(data).mapInArrow(sums, "total binary").collect())
        slope = total[:-1] / total[-1] + decay * np.concatenate([[0.0], state[1:]])
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        state = state - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(picked, float(state[0]), state[1 : size + 1], state[size + 1 :].reshape(size, factors))


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(model.features(part.tolist())))

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    scored = texts(docs).select("doc_id", scorer(train(docs, labels))(F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, columns as they were."""
    return docs.where(scorer(train(docs, labels))(F.col("text")) < threshold)
