"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

log P(word | before) = log P(class | before) + log P(word | class).

- Counts of every training token come from all training texts by one grouped sum. The most frequent words, a
  fixed number of them, are the dictionary that tasks hold; all other counts stay in a table.
- The most frequent words are classes of their own, further dictionary words are dealt into classes of
  equal mass, and all other words make up the last class.
- P(class | before) is a softmax over sums of weights of hashed features: the word before (bigram), the two
  before (trigram), and the one before that alone (skip), and a bias. Within a class the softmax has word biases
  only, whose optimum is the relative count; in the last class every count is one more, and one unit
  is left for unknown words, so the probabilities of all words sum to one.
- Training goes once over all training tokens, in rounds over disjoint parts of the documents. In a round, each
  task starts from the last weights and takes gradient steps batch by batch; tasks' weights are then
  averaged by their tokens, block by block of the weight table, by a shuffle on the block.
- Scoring reads every text once. Words outside the dictionary go, once a document, to a join with the table
  of counts; as they are rarer than every dictionary word, none is a hot key.

A null text is an empty one: its end token is all it has. A null doc_id counts as the text '' in the fold.
Rows are told apart by locators, so repeated rows are each scored; other columns are ignored; texts of any length are scored whole; words of
equal counts are ordered by their bytes. Without training rows every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import located, slices
from findery.session import store

END = b""  # no word is empty
CLASSES, ALONE, ROWS, BLOCKS, STEP = 32, 24, 1 << 14, 16, 8192
PAD = -1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str) -> list[bytes]:
    """ASCII lower-casing and ASCII white space, which is what bytes know of."""
    return text.encode().lower().split()


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all training texts; END counts the documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for text in part.column("text").to_pylist():
                    counts.update(words_of(text))
                    counts[END] += 1
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=2)
def places(joined: bytes) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(joined.split(b" "))} if joined else {END: 0}


@dataclass
class Model:
    """The dictionary by falling count, with END first, and the weights of classes."""

    joined: bytes  # the words, between spaces
    counts: np.ndarray
    classes: np.ndarray  # of dictionary words, then of all others
    total: int  # training tokens
    distinct: int
    weights: np.ndarray  # features x classes
    bias: np.ndarray

    def __post_init__(self) -> None:
        n = len(self.counts)
        self.other_total, self.other_distinct = self.total - int(self.counts.sum()), self.distinct - n
        mass = np.bincount(self.classes[:n], self.counts, len(self.bias))
        with np.errstate(divide="ignore"):
            inside = np.log10(self.counts) - np.log10(mass[self.classes[:n]])
            base = np.log10((self.counts + 1) / (self.total + self.distinct + 1))
        # An other word's own count is added by the join.
        self.inside, self.base = np.append(inside, 0.0), np.append(base, 0.0)

    def ids(self, words: list[bytes]) -> list[int]:
        place, other = places(self.joined), len(self.counts)
        return [place.get(w, other) for w in words]


def features(ids: np.ndarray) -> np.ndarray:
    """The hashed features of each position, three rows: the word before, the two before, the second before."""
    first = np.concatenate([[PAD, PAD], ids[:-1]])[1:].astype(np.uint64) + np.uint64(2)
    second = np.concatenate([[PAD, PAD], ids[:-2]])[: len(ids)].astype(np.uint64) + np.uint64(2)
    keys = np.stack([first * np.uint64(3), (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F)), second * np.uint64(3) + np.uint64(1)])
    keys = (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys >> np.uint64(50)).astype(np.int64) % ROWS


def sequence(model: Model, many: list[list[bytes]]) -> np.ndarray:
    """The documents' ids one after another, each with END behind and two pads before."""
    end = places(model.joined)[END] if len(model.counts) else 0
    out: list[int] = []
    for words in many:
        out += [PAD, PAD, *model.ids(words), end]
    return np.array(out, np.int64)


def log_classes(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log P(class) of positions, by their sparse features."""
    logits = weights[at[0]] + weights[at[1]] + weights[at[2]] + bias
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def class_scores(model: Model, ids: np.ndarray) -> np.ndarray:
    """log10 P(class of the word) at every position, 0 at pads."""
    at, out = features(ids), np.zeros(len(ids))
    for start in range(0, len(ids), STEP):
        part = slice(start, start + STEP)
        logs = log_classes(model.weights, model.bias, at[:, part])
        own = ids[part]
        out[part] = np.where(own == PAD, 0.0, logs[np.arange(len(own)), model.classes[own]] / math.log(10))
    return out


def descend(weights: np.ndarray, bias: np.ndarray, at: np.ndarray, target: np.ndarray, rate: float) -> None:
    """A gradient step in place; a row moves by the mean over the positions that have its feature."""
    slope = np.exp(log_classes(weights, bias, at))
    slope[np.arange(len(target)), target] -= 1
    for rows in at:
        order = np.argsort(rows, kind="stable")
        found, starts, sizes = np.unique(rows[order], return_index=True, return_counts=True)
        weights[found] -= rate * np.add.reduceat(slope[order], starts, axis=0) / sizes[:, None].astype(np.float32)
    bias -= rate * slope.mean(0)


def improved(model: Model, part: DataFrame, rate: float) -> Model:
    """One round: tasks' weights after their own steps, averaged by tokens."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, seen, rest = model.weights.copy(), model.bias.copy(), 0, []
        size = 0

        def step() -> None:
            ids = np.concatenate(rest)
            at, real = features(ids), ids != PAD
            at, target = at[:, real], model.classes[ids[real]]
            for start in range(0, len(target), STEP):
                descend(weights, bias, at[:, start : start + STEP], target[start : start + STEP], rate)

        for batch in batches:
            for piece in slices(batch, 50):
                rest.append(sequence(model, [words_of(t) for t in piece.column("text").to_pylist()]))
                size += len(rest[-1])
                if size >= STEP:
                    step()
                    seen += size
                    rest, size = [], 0
        if size:
            step()
            seen += size
        if seen:
            table = np.vstack([weights, np.broadcast_to(bias, (BLOCKS, len(bias)))]).astype(np.float64) * seen
            pieces = np.vsplit(table[:ROWS], BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(BLOCKS), pa.int32()), pa.array([p.astype("f4").tobytes() for p in pieces], pa.binary()),
                    pa.array([(bias * seen).astype("f8").tobytes()] * BLOCKS, pa.binary()), pa.array([seen] * BLOCKS, pa.int64()),
                ],
                ["block", "weights", "bias", "seen"],
            )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = totals.setdefault(r["block"], [0.0, 0.0, 0])
                own[0] = own[0] + np.frombuffer(r["weights"], "f4").astype("f8")
                own[1] = own[1] + np.frombuffer(r["bias"], "f8")
                own[2] += r["seen"]
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32())] + [pa.array([(t[i] / t[2]).tobytes() for t in totals.values()], pa.binary()) for i in (0, 1)],
                ["block", "weights", "bias"],
            )

    moved = part.select("text").mapInArrow(run, "block int, weights binary, bias binary, seen long")
    # One row a block, of fixed size: the whole model.
    rows = moved.repartition(BLOCKS, "block").mapInArrow(add, "block int, weights binary, bias binary").collect()
    if not rows:
        return model
    weights = np.concatenate([np.frombuffer(r.weights) for r in sorted(rows, key=lambda r: r.block)])
    return Model(
        model.joined, model.counts, model.classes, model.total, model.distinct,
        weights.reshape(ROWS, -1).astype(np.float32), np.frombuffer(rows[0].bias).astype(np.float32),
    )


def blank(counts: DataFrame, words: int) -> Model:
    """The dictionary, its classes, and weights of a plain class model."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # Words by the size of their count, in steps of a sixteenth of a doubling: some hundred rows at most. The
    # dictionary is END and the words of the largest steps that are `words` together, so no task sends a full list.
    step = F.floor(F.log2("n") * 16).cast("int")
    least, room = 0, words - 1
    for r in counts.where(F.length("word") > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        room -= r.n
        if room < 0:
            least = r.step + 1
            break
    top = [(bytes(r.word), r.n) for r in counts.where((step >= least) | (F.length("word") == 0)).collect()]
    top.sort(key=lambda r: (r[0] != END, -r[1], r[0]))
    n = np.array([c for _, c in top], np.float64)
    classes = np.full(len(top) + 1, CLASSES - 1)
    classes[: min(ALONE, len(top))] = range(min(ALONE, len(top)))
    if len(top) > ALONE:
        share = np.cumsum(n[ALONE:]) / n[ALONE:].sum()
        classes[ALONE:-1] = ALONE + np.minimum((share * (CLASSES - 1 - ALONE)).astype(int), CLASSES - 2 - ALONE)
    mass = np.bincount(classes, np.append(n, total - n.sum()), CLASSES)
    mass[CLASSES - 1] += 1
    bias = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
    joined = b" ".join(w for w, _ in top)
    return Model(joined, n, classes, total, distinct, np.zeros((ROWS, CLASSES), np.float32), bias)


def train(given: DataFrame, words: int, rounds: int, rate: float) -> tuple[Model, DataFrame]:
    """The model of (doc_id, text) rows that are not held out, and the table of all counts."""
    own = given.where(~held_out(F.col("doc_id")))
    counts = store(count_words(own))
    model = blank(counts, words)
    for i in range(rounds):
        model = improved(model, own.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i), rate)
    return model, counts


SCORED = (
    "file long, row long, doc_id long, word binary, times long, n_tokens long, n_known long, base_score double, score double"
)


def partial_scores(given: DataFrame, model: Model) -> DataFrame:
    """A row a document with the sums over its dictionary words, under a key that no word has, and a row for each
    other word of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        other = len(model.counts)
        for batch in batches:
            for part in slices(batch):
                cut = [words_of(t) for t in part.column("text").to_pylist()]
                ids = sequence(model, cut)
                real = ids != PAD
                owner = np.repeat(np.arange(len(cut)), [len(words) + 1 for words in cut])
                ids, logs = ids[real], class_scores(model, ids)[real]
                known, n = ids < other, len(cut)
                seen = np.bincount(owner, known, n)
                base = np.bincount(owner, model.base[ids], n)
                score = np.bincount(owner, logs + model.inside[ids], n)
                file, row, doc = (part.column(c).to_pylist() for c in ("file", "row", "doc_id"))
                out = [
                    (file[i], row[i], doc[i], b"%d %d" % (file[i], row[i]), 0, len(cut[i]) + 1, int(k), float(base[i]), float(score[i]))
                    for i, k in enumerate(seen)
                ]
                known[np.cumsum([len(words) + 1 for words in cut]) - 1] = True  # END needs no join
                rare = np.flatnonzero(~known)
                at = rare - owner[rare]  # without the END of the documents before
                words = [w for ws in cut for w in ws]
                for (i, w), times in Counter(zip(owner[rare].tolist(), map(words.__getitem__, at.tolist()), strict=True)).items():
                    out.append((file[i], row[i], doc[i], w, times, 0, 0, 0.0, 0.0))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=ARROW)

    return given.mapInArrow(run, SCORED)


ARROW = pa.schema([
    ("file", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()),
    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])


def language_scores(docs: DataFrame, words: int = 200_000, rounds: int = 2, rate: float = 0.5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    `words` bounds the dictionary that tasks hold; counts of all words are used whatever it is.
    """
    placed, file, row = located(docs)
    given = placed.select(
        F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    model, counts = train(given, words, rounds, rate)
    joined = partial_scores(given, model).join(counts, "word", "left")
    c, times = F.coalesce("n", F.lit(0)), F.col("times")

    def log_share(of: int) -> Column:
        return F.when(times > 0, times * (F.log10(c + 1) - F.lit(math.log10(of)))).otherwise(0.0)

    found = joined.groupBy("file", "row", "doc_id").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + log_share(model.total + model.distinct + 1)).alias("base_score"),
        F.sum(F.col("score") + log_share(model.other_total + model.other_distinct + 1)).alias("score"),
    )
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
