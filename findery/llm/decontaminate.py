"""Benchmark decontamination by latent semantic retrieval.

1. Every text is cut into hashed words once, which are written, four bytes a word; later steps read them in its place.
   Document frequencies of terms are counted over all texts, one sum a term.
2. Every passage of `width` words, of all texts and benchmark items, is a TF-IDF row. A randomised SVD over them
   runs as a Spark job: each task multiplies its rows with a random basis and the products are summed; the
   driver holds one terms x dimensions matrix, whose size is fixed.
3. Every text's words are read once more. The latent vectors of its windows are differences of running sums, for some
   window lengths near those of the items, and are compared by cosine with the items of like length, in blocks
   of `block` items. No text is shuffled and no candidate leaves its task.
   Words that many texts hold weigh little or nothing, also where a hot group of copies or a shared passage has made
   them common, so a vector may consist of what a paraphrase replaced. An item whose lightest words could
   reach `likely` below the cosine is therefore compared in full as well: with every stretch of the text that has
   as many of its rarest words as any leak must have, which leaves out nothing that step 4 would find.
4. A candidate region, twice the window, is checked by the longest common subsequence of words: an item has
   leaked when at least `sure` of its words stand there in order, or at least `likely` of them, as in a
   paraphrase, with its whole answer: the words of its answer column, if there is one, else those
   of its last sentence's last `answer_words`.

The row of a null or empty text has no finding; an item without words is never found; repeated rows and items
are each reported; null ids are kept. Texts are searched to their ends, long ones in spans that overlap by more than any
region. Of an item's regions in a text the one with the longest common subsequence is reported; ties go to the larger cosine, then to a
whole answer, then to the earlier region. Empty tables, of either kind, give no finding; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import texts
from findery.llm.repeats import SPACE, blocks, span_hashes, word_spans
from findery.session import store

TERM_BITS = 15
TERMS = 1 << TERM_BITS
#: How rare by chance (as minus the logarithm) regions are to be that the full search looks at.
RARE = 8.0
#: Pieces in which sums of the size of the basis are added up.
BLOCKS = 16
#: Weights that are multiplied at once, few enough for the matrix of their rows and terms to stay small.
AT_ONCE = 512
#: Texts and words that are searched as one, few enough for their running sums to stay in a core's cache, and the words
#: at which longer texts are cut.
TOGETHER, WORDS, SPAN = 24, 16_384, 4_096
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer boolean, first_word long"
EDGES = b".,;:!?\"'()[]{}<>|*-"


#: Bytes after ASCII lower-casing, and those that are part of a word but not of what it is known by.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
EDGE = np.zeros(256, bool)
EDGE[list(EDGES)] = True


def core_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word without the punctuation around it, if anything is left."""
    flat = LOWER[flat]
    starts, ends = word_spans(flat)
    inner = ~(SPACE[flat] | EDGE[flat])
    before = np.concatenate([[0], np.cumsum(inner)])
    left = before[ends] > before[starts]
    places = np.flatnonzero(inner)
    first, last = places[before[starts[left]]], places[before[ends[left]] - 1]
    return first, span_hashes(flat, first, last + 1)


def identities(given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words a text, their identities); words of punctuation alone are left out."""
    raw = [t.encode() for t in given.to_pylist()]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for offset, part in blocks(np.frombuffer(b"\n".join(raw), np.uint8)):
        at, own = core_hashes(part)
        starts.append(at + offset)
        hashes.append(own)
    owner = np.searchsorted(begins, np.concatenate(starts), side="right") - 1
    return np.bincount(owner, minlength=len(raw)), np.concatenate(hashes).astype("<u4")


def with_terms(ids: np.ndarray) -> np.ndarray:
    """(identity, term) of each word."""
    return np.stack([ids, ids >> np.uint32(32 - TERM_BITS)], 1)


def term_rows(given: pa.Array | list[str]) -> list[np.ndarray]:
    """Each text's words as (identity, term), in order."""
    counts, ids = identities(given if isinstance(given, pa.Array) else pa.array(given, pa.string()))
    return np.split(with_terms(ids), np.cumsum(counts)[:-1]) if len(counts) else []


def cut(docs: DataFrame) -> DataFrame:
    """(doc_id, words): the identities of each text's words, four bytes a word, cut once and kept for every later step."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids = identities(batch.column("text"))
            data, ends = ids.tobytes(), np.cumsum([0, *(4 * counts)])
            words = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), words], ["doc_id", "words"])

    return store(texts(docs).mapInArrow(run, "doc_id long, words binary"))


def kept_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words a text, their identities) of what `cut` kept."""
    raw = words.to_pylist()
    return np.array([len(r) // 4 for r in raw], np.int64), np.frombuffer(b"".join(raw), "<u4")


def kept_rows(words: pa.Array) -> list[np.ndarray]:
    """Each text's words as (identity, term), in order."""
    counts, ids = kept_words(words)
    return np.split(with_terms(ids), np.cumsum(counts)[:-1]) if len(counts) else []


def document_frequencies(kept: DataFrame) -> tuple[int, int, np.ndarray]:
    """The number of texts, of their words and, by term, of texts that have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n, words = np.zeros(TERMS, np.int64), 0, 0
        for batch in batches:
            sizes, ids = kept_words(batch.column("words"))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            counts += np.bincount(pd.unique(owner * TERMS + with_terms(ids)[:, 1]) % TERMS, minlength=TERMS)
            words += len(ids)
            n += batch.num_rows
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([words, n, *counts[some].tolist()], pa.int64())], ["term", "n"])

    # A row a term, TERMS at most.
    rows = kept.select("words").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts, total, words = np.zeros(TERMS, np.int64), 0, 0
    for r in rows:
        if r.term == -1:
            total = r.n
        elif r.term == -2:
            words = r.n
        else:
            counts[r.term] = r.n
    return total, words, counts


def passages(words: pa.Array, idf: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(where passages start, terms, weights): TF-IDF rows of unit length, of every passage of `width` words, some at a time."""
    sizes, ids = kept_words(words)
    terms = ids >> np.uint32(32 - TERM_BITS)
    begins = np.cumsum(sizes) - sizes
    # A text's last passage may be shorter; numbers of passages grow from text to text.
    each = -(-sizes // width)
    first = np.cumsum(each) - each
    owner = np.repeat(np.arange(len(sizes)), sizes)
    heavy = np.flatnonzero(idf[terms] > 0)
    passage = first[owner[heavy]] + (heavy - begins[owner[heavy]]) // width
    keys, times = np.unique(passage * TERMS + terms[heavy], return_counts=True)
    passage, terms = keys // TERMS, (keys % TERMS).astype(np.uint16)
    weight = (times * idf[terms]).astype(np.float32)
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    if not len(starts):
        return
    counts = np.diff(starts, append=len(keys))
    weight /= np.repeat(np.sqrt(np.add.reduceat(weight**2, starts)), counts)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + AT_ONCE)))
        a, b = starts[low], starts[high] if high < len(starts) else len(keys)
        yield starts[low:high] - a, terms[a:b], weight[a:b]
        low = high


def add_product(total: np.ndarray, basis: np.ndarray, starts: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> None:
    """Adds A'AQ of some rows of A, as a dense matrix over the terms that they have."""
    counts = np.diff(starts, append=len(terms))
    own, at = np.unique(terms, return_inverse=True)
    some = np.zeros((len(starts), len(own)), np.float32)
    some[np.repeat(np.arange(len(starts)), counts), at] = weight
    total[own] += some.T @ (some @ basis[own])


def summed(kept: DataFrame, idf: np.ndarray, width: int, basis: np.ndarray) -> np.ndarray:
    """A'AQ over all rows of A, the passages of all texts. Each core makes one sum, however many texts there are; sums
    meet block by block, and the driver gets one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape, np.float32)
        for batch in batches:
            for starts, terms, weight in passages(batch.column("words"), idf, width):
                add_product(total, basis, starts, terms, weight)
        for block, part in enumerate(np.vsplit(total, BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                part = np.frombuffer(r["part"], "f4")
                sums[r["block"]] = sums[r["block"]] + part if r["block"] in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "part"])

    kind = "block int, part binary"
    cores = kept.sparkSession.sparkContext.defaultParallelism
    found = kept.select("words").coalesce(cores).mapInArrow(run, kind).repartition(BLOCKS, "block").mapInArrow(add, kind).collect()
    return np.concatenate([np.frombuffer(r.part, "f4") for r in sorted(found, key=lambda r: r.block)]).reshape(basis.shape)


def latent_basis(kept: DataFrame, idf: np.ndarray, width: int, dimensions: int, skip: int, extra: int = 8, seed: int = 11) -> np.ndarray:
    """Right singular vectors of all texts' passages, by a randomised Nystrom approximation with one pass over them.

    With Y = A'AQ, A'A is near Y (Q'Y)^-1 Y', whose eigenvectors are the left singular vectors of Y (Q'Y)^-1/2. The first
    `skip` vectors are left out: they tell languages and kinds of text apart, which makes all passages of one kind alike.
    """
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(TERMS, skip + dimensions + extra)))[0].astype(np.float32)
    product = summed(kept, idf, width, basis).astype(np.float64)
    inner = basis.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    real = values > 1e-6 * max(values.max(), 1e-9)
    found = np.linalg.svd(product @ (turn[:, real] / np.sqrt(values[real])), full_matrices=False)[0][:, skip : skip + dimensions]
    vectors = np.zeros((TERMS, dimensions), np.float32)
    vectors[:, : found.shape[1]] = found
    return vectors


@dataclass
class Space:
    """Latent vectors of terms, weighted by idf, with one of zeros behind them. Terms of too many texts have no
    weight and are skipped. Rates are texts with the term by words of all texts."""

    vectors: np.ndarray
    idf: np.ndarray
    rates: np.ndarray
    weighs: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.weighs = self.idf > 0

    def places(self, row: np.ndarray) -> np.ndarray:
        """Where the words with weight stand."""
        return np.flatnonzero(self.weighs[row[:, 1]])


def weights(total: int, counts: np.ndarray, common: float) -> np.ndarray:
    """idf above that of a term which `common` of all texts have."""
    return np.maximum(0.0, np.log((common * total + 1) / (counts + 1)))


def fit(kept: DataFrame, benchmark: DataFrame, dimensions: int, width: int, common: float, skip: int) -> Space:
    """Frequencies from all texts, the basis from all passages of all texts and items."""
    total, words, counts = document_frequencies(kept)
    idf = weights(total, counts, common)
    items = cut(benchmark.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    weighted = latent_basis(kept.unionByName(items), idf, width, dimensions, skip) * idf[:, None].astype(np.float32)
    return Space(np.vstack([weighted, np.zeros((1, dimensions), np.float32)]), idf, counts / max(1, words))


@dataclass
class Item:
    item_id: int | None
    words: list[int]
    answer: list[int]
    masks: dict[int, int] = field(init=False)
    bag: Counter = field(init=False)

    def __post_init__(self) -> None:
        self.masks, self.bag = {}, Counter(self.words)
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def shares(self, region: list[int], least: int) -> bool:
        """Whether the region has `least` of the item's words, each counted as often as the item has it: no fewer than any
        common subsequence."""
        return sum(map(self.bag.__getitem__, self.bag.keys() & set(region))) >= least

    def lcs(self, region: list[int]) -> int:
        """The longest common subsequence with the region's words, a bit a word of the item."""
        full = (1 << len(self.words)) - 1
        row = full
        for w in region:
            hit = self.masks.get(w)
            if hit:
                both = row & hit
                row = (row + both | row - both) & full
        return len(self.words) - row.bit_count()


def holds(region: list[int], answer: list[int]) -> bool:
    n = len(answer)
    return n > 0 and any(region[i : i + n] == answer for i in range(len(region) - n + 1))


class FullSearch:
    """Regions of texts, of every item's length and half of it on both sides, that may hold `likely` of its words.

    If m of an item's n words are matched, at least m - (n - r) of its r rarest are, so regions with fewer of these
    need no comparison, whatever r is: the smallest by which such regions are rare enough, since common words
    cost most to follow. Nor do regions that share fewer than m words with the item, each as often as it has it.
    """

    def __init__(self, items: list[Item], rows: list[np.ndarray], rates: np.ndarray, likely: float) -> None:
        self.items, pairs, needs = items, [], []
        self.least = [max(1, math.ceil(likely * len(row) - 1e-9)) for row in rows]
        for i, row in enumerate(rows):
            n = len(row)
            rate = rates[row[:, 1]]
            order = np.argsort(rate, kind="stable")
            fresh = np.zeros(n, bool)
            fresh[np.unique(row[order, 0], return_index=True)[1]] = True
            r = np.arange(1, n + 1)
            need = r - (n - self.least[len(needs)])
            chance = 2 * n * np.cumsum(np.where(fresh, rate[order], 0.0)) + 1e-6
            odds = np.where(need > chance, need * np.log(np.maximum(need, 1) / chance) - need + chance, 0.0)
            odds[need < 1] = -1.0
            best = int(np.argmax(odds >= min(RARE, odds.max())))
            needs.append(int(need[best]))
            pairs += [(w, t, i) for w, t in set(map(tuple, row[order[: best + 1]].tolist()))]
        pairs.sort()
        self.needs, self.sizes = np.array(needs, np.int64), np.array([len(row) for row in rows], np.int64)
        words = np.array([w for w, _, _ in pairs], np.int64)
        self.words, self.starts, self.counts = np.unique(words, return_index=True, return_counts=True)
        self.owners = np.array([i for _, _, i in pairs], np.int32)
        self.known = np.zeros(TERMS, bool)
        self.known[[t for _, t, _ in pairs]] = True

    def regions(self, rows: list[np.ndarray]) -> Iterator[tuple[int, Item, int]]:
        """(text, item, start of its window)."""
        if not self.items or not sum(map(len, rows)):
            return
        room = 2 * int(self.sizes.max()) + 2
        begins = np.cumsum([0, *(len(row) + room for row in rows)])
        at = np.concatenate([begin + np.flatnonzero(self.known[row[:, 1]]) for begin, row in zip(begins, rows, strict=False)])
        ids = np.concatenate([row[self.known[row[:, 1]], 0] for row in rows]).astype(np.int64)
        place = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        real = self.words[place] == ids
        at, place = at[real], place[real]
        times = self.counts[place]
        owner = self.owners[np.repeat(self.starts[place] - np.cumsum(times) + times, times) + np.arange(times.sum())]
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], np.repeat(at, times)[order]
        last = np.arange(len(owner)) + self.needs[owner] - 1
        inside = np.minimum(last, len(owner) - 1)
        # A region has n words and n // 2 on both sides; the room between texts is wider.
        near = (last < len(owner)) & (owner[inside] == owner) & (at[inside] - at < self.sizes[owner] + 2 * (self.sizes[owner] // 2))
        seen: set[tuple[int, int, int]] = set()
        words: dict[int, list[int]] = {}
        for i, first, end in zip(owner[near].tolist(), at[near].tolist(), at[inside[near]].tolist(), strict=True):
            text = int(np.searchsorted(begins, first, side="right")) - 1
            first, end, n = first - int(begins[text]), end - int(begins[text]), int(self.sizes[i])
            step = max(1, n // 2)
            for start in range(max(0, -(-(end - n - n // 2 + 1) // step) * step), min(first + n // 2, len(rows[text]) - 1) + 1, step):
                if (text, i, start) not in seen:
                    seen.add((text, i, start))
                    if text not in words:
                        words[text] = rows[text][:, 0].tolist()
                    if self.items[i].shares(words[text][max(0, start - n // 2) : start + n + n // 2], self.least[i]):
                        yield text, self.items[i], start


class Searcher:
    """The items of a block by window length, with their latent vectors.

    Lengths count words with weight. An item of fewer than `few` such words has no fair vector. It is compared
    with every window of the text, and so is an item whose lightest words, as many as `likely` asks for, have a
    cosine below the bound with the whole item.
    """

    def __init__(self, space: Space, items: list[Item], rows: list[np.ndarray], cosine: float, sure: float, likely: float, few: int = 3) -> None:
        self.space, self.cosine, self.sure, self.likely = space, cosine, sure, likely
        self.lengths: dict[int, tuple[list[Item], np.ndarray]] = {}
        full: list[tuple[Item, np.ndarray]] = []
        by_length: dict[int, list[tuple[Item, np.ndarray]]] = {}
        for item, row in zip(items, rows, strict=True):
            at = space.places(row)
            if len(at) >= few:
                # Lengths grow by half: 6, 9, 14, 21, 32, ...; an item is at most a fifth longer than its windows.
                length = 6
                while length * 1.2 < len(at):
                    length = -(-length * 3 // 2)
                by_length.setdefault(length, []).append((item, space.vectors[row[at, 1]].sum(0)))
            if len(row) and (len(at) < few or self.misses(row)):
                full.append((item, row))
        self.reach = 4 * max([1, *(len(item.words) for item in items), *by_length])
        self.full = FullSearch([item for item, _ in full], [row for _, row in full], space.rates, likely)
        for length, own in by_length.items():
            vectors = np.stack([v for _, v in own])
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            self.lengths[length] = ([item for item, _ in own], vectors.T.astype(np.float32).copy())

    def misses(self, row: np.ndarray) -> bool:
        """Whether a leak of the item can have too small a cosine."""
        squares = np.sort(self.space.idf[row[:, 1]]) ** 2
        least = squares[: math.ceil(self.likely * len(row) - 1e-9)]
        return least.sum() < self.cosine**2 * squares.sum()

    def check(self, item: Item, region: list[int]) -> tuple[float, bool] | None:
        if not item.shares(region, max(1, math.ceil(self.likely * len(item.words) - 1e-9))):
            return None
        share = item.lcs(region) / len(item.words)
        if share < self.likely:
            return None
        answer = holds(region, item.answer)
        return (share, answer) if share >= self.sure or answer else None

    def candidates(self, rows: list[np.ndarray]) -> Iterator[tuple[int, Item, float, int, int]]:
        """(text, item, cosine, start, end) of windows that may hold an item, in words.

        The texts' words with weight lie one after another, with room without weight between them for the
        longest window, so no window sees two texts and the last windows of a text are cut at its end.
        """
        room, places = max(self.lengths, default=0), [self.space.places(row) for row in rows]
        begins = np.cumsum([0, *(len(at) + room for at in places)])
        terms_at = np.full(begins[-1], TERMS, np.int64)
        for begin, at, row in zip(begins, places, rows, strict=False):
            terms_at[begin : begin + len(at)] = row[at, 1]
        running = np.zeros((len(terms_at) + 1, self.space.vectors.shape[1]), np.float32)
        np.cumsum(self.space.vectors[terms_at], axis=0, out=running[1:])
        for length, (items, vectors) in self.lengths.items():
            step = max(1, length // 3)
            ends = running[length::step]
            windows = ends - running[::step][: len(ends)]
            sizes = np.sqrt(np.einsum("ij,ij->i", windows, windows))
            likeness = windows @ vectors
            near = np.flatnonzero(likeness >= self.cosine * np.maximum(sizes, 1e-3)[:, None])
            w, item = np.divmod(near, len(items))
            text = np.searchsorted(begins, w * step, side="right") - 1
            start = w * step - begins[text]
            likely = likeness[w, item] / sizes[w]
            for t, i, c, a in zip(text.tolist(), item.tolist(), likely.tolist(), start.tolist(), strict=True):
                at = places[t]
                if a < len(at):
                    yield t, items[i], c, int(at[a]), int(at[min(a + length, len(at)) - 1]) + 1
        for text, item, start in self.full.regions(rows):
            yield text, item, 0.0, start, start + len(item.words)

    def spans(self, rows: list[np.ndarray]) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Groups of (text, first word, words): texts cut into spans that overlap by more than a region's length."""
        group: list[tuple[int, int, np.ndarray]] = []
        held, span = 0, max(SPAN, self.reach)
        for text, row in enumerate(rows):
            for start in range(0, max(1, len(row)), span):
                low = max(0, start - self.reach)
                piece = row[low : start + span + self.reach]
                if group and (len(group) == TOGETHER or held + len(piece) > WORDS):
                    yield group
                    group, held = [], 0
                group.append((text, low, piece))
                held += len(piece)
        if group:
            yield group

    def find(self, rows: list[np.ndarray]) -> list[list[tuple]]:
        """Of each text's words: (item_id, cosine, lcs, answer, first word) of every item that has leaked."""
        out: list[dict[int, tuple]] = [{} for _ in rows]
        for group in self.spans(rows):
            words: dict[int, list[int]] = {}
            for piece, item, cosine, start, end in self.candidates([own for _, _, own in group]):
                text, first, own = group[piece]
                if piece not in words:
                    words[piece] = own[:, 0].tolist()
                margin = max(end - start, len(item.words)) // 2 + max(0, len(item.words) - (end - start))
                low = max(0, start - margin)
                hit = self.check(item, words[piece][low : end + margin])
                if hit:
                    best = (hit[0], cosine, hit[1], -low - first)
                    if id(item) not in out[text] or best > out[text][id(item)][1]:
                        out[text][id(item)] = (item.item_id, best)
        return [[(item_id, cosine, share, answer, -low) for item_id, (share, cosine, answer, low) in found.values()] for found in out]


def item_blocks(benchmark: DataFrame, block: int, answer_words: int) -> Iterator[tuple[list[Item], list[np.ndarray]]]:
    """The benchmark's items, `block` at a time."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), answer.alias("answer"))
    held: list = []

    def made() -> tuple[list[Item], list[np.ndarray]]:
        rows = term_rows([r.text for r in held])
        ends = term_rows([r.answer or re.split(r"[.!?]\s", r.text.strip())[-1] for r in held])
        items = [
            Item(r.item_id, row[:, 0].tolist(), end[:, 0].tolist() if r.answer else end[-answer_words:, 0].tolist())
            for r, row, end in zip(held, rows, ends, strict=True)
        ]
        return items, rows

    for r in given.orderBy("item_id", "text").toLocalIterator():
        held.append(r)
        if len(held) == block:
            yield made()
            held = []
    if held:
        yield made()


def searchers(kept: DataFrame, benchmark: DataFrame, dimensions: int = 80, width: int = 40, block: int = 1_000,
              cosine: float = 0.6, sure: float = 0.8, likely: float = 0.6,
              answer_words: int = 5, common: float = 0.05, skip: int = 16) -> Iterator[Searcher]:
    space = fit(kept, benchmark, dimensions, width, common, skip)
    for own, rows in item_blocks(benchmark, block, answer_words):
        yield Searcher(space, own, rows, cosine, sure, likely)


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, first_word) of every row of docs and item that it holds.

    first_word is where the checked region starts, among the text's words that are not punctuation alone.
    """
    kept = cut(docs)

    def search(searcher: Searcher) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = zip(batch.column("doc_id").to_pylist(), searcher.find(kept_rows(batch.column("words"))), strict=True)
                found = [(doc_id, *hit) for doc_id, own in hits for hit in own]
                columns = zip(*found, strict=True) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

        return kept.mapInArrow(run, FOUND)

    out = None
    for searcher in searchers(kept, benchmark, **options):
        one = search(searcher)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], FOUND) if out is None else out


NAMES = ["doc_id", "item_id", "cosine", "lcs", "answer", "first_word"]
TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]


def leak_test(searcher: Searcher):
    @F.pandas_udf("boolean")
    def leaked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(map(bool, searcher.find(term_rows(part.tolist())))), dtype=bool)

    def of(text: Column) -> Column:
        return leaked(F.coalesce(text.cast("string"), F.lit("")))

    return of


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item, columns as they were."""
    out = docs
    for searcher in searchers(cut(docs), benchmark, **options):
        out = out.where(~leak_test(searcher)(F.col("text")))
    return out
