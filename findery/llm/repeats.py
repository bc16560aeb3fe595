"""Repeated passages: windows of words that stand in more than one place, found by super-k-mers.

1. Every run of `gram` words has a hash; the smallest in a window of `width` words is the window's minimiser (of
   equal ones the leftmost). Consecutive windows that share a minimiser's place are one super-k-mer. Equal windows have
   equal minimisers, so a window can only repeat if its minimiser stands at the head of two super-k-mers.
   Minimisers are counted first, and only super-k-mers of repeated ones travel.
2. The words of each of those are cut out as one packed string, named by its 128-bit digest. Equal strings of a task are one
   row with a list of places, so a passage of very many documents is few rows. Strings go to their minimiser's bucket;
   there their windows are sorted, whole words and all, and equal neighbours counted.
3. A bucket of more than `crowd` rows, as a passage with many different surroundings makes, is no single task's: the
   windows of its strings are grouped as rows, partial counts first. The result is the same.
4. The marks of a string go back to its places, and a document's words are read once more to leave out those covered.

Every task holds one text, some thousand packed strings, or one bucket of at most `crowd` strings of at most 2 * width - gram words. Words are the runs
between ASCII white space, compared as they are. Null and empty texts have no words; texts shorter than a window
lose none; repeated rows are places of their own, so they repeat each other; null doc_ids are kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import grouped, located
from findery.session import store

SCANNED = "file long, row long, doc_id long, n_words long, sha string, minis array<long>, starts array<int>, counts array<int>"
PIECES = "mini long, digest binary, packed binary, places array<struct<file:long,row:long,start:int>>"
MASKS = "digest binary, mask long"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are hashed at once, and places among which equal strings are sought before they are sent.
BLOCK, SENT = 1 << 20, 10_000
BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
    up[1:], down[1:] = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from sums that run over all of them once."""
    up, down = _powers(max(BLOCK, 1 << int(len(flat)).bit_length()))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_spans(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs without white space start and end."""
    edge = np.diff(np.concatenate([[True], SPACE[flat], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def blocks(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of some bytes at a time, cut behind white space; a longer word is a block of its own."""
    at = 0
    while at < len(flat):
        end = min(at + BLOCK, len(flat))
        while end < len(flat):
            gaps = np.flatnonzero(SPACE[flat[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + BLOCK, len(flat))
        yield at, flat[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word."""
    return np.concatenate([np.zeros(0, np.uint64), *(span_hashes(part, *word_spans(part)) for _, part in blocks(np.frombuffer(data, np.uint8)))])


def window_minima(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each `size` neighbours and the leftmost place that has it, in log2(size) steps."""
    value, place, width = hashes, np.arange(len(hashes), dtype=np.int64), 1
    while width < size and len(value):
        shift = min(width, size - width)
        left, right = value[:-shift], value[shift:]
        less = right < left
        value, place = np.where(less, right, left), np.where(less, place[shift:], place[:-shift])
        width += shift
    return value, place


def super_kmers(words: np.ndarray, sizes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, minimiser, start, windows) of the super-k-mers of word hashes that lie one document after another."""
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < width:
        return none
    grams, done = words, 1
    while done < gram:
        step = min(done, gram - done)
        grams = grams[:-step] * np.uint64(pow(BASE, 2 * step + 1, 1 << 64)) + grams[step:]
        done += step
    least, place = window_minima(mix(grams), width - gram + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(owner[: len(words) - width + 1] == owner[width - 1 :])
    if not len(inside):
        return none
    heads = np.flatnonzero(np.concatenate([[True], np.diff(place[inside]) != 0]))
    first = inside[heads]
    counts = np.diff(np.concatenate([heads, [len(inside)]]))
    docs = owner[first]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return docs, least[first].view(np.int64), first - offsets[docs], counts


def _portions(texts: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` characters, at least one each."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text)
    if texts:
        yield start, len(texts)


def scan(placed: DataFrame, file: str, row: str, width: int, gram: int) -> DataFrame:
    """A row a document: its words counted, the checksum of all of them, and its super-k-mers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in _portions(texts):
                raw = [t.encode() for t in texts[low:high]]
                cut = [t.split() for t in raw]
                sizes = np.array([len(c) for c in cut])
                docs, minis, starts, counts = super_kmers(word_hashes(b" ".join(raw)), sizes, width, gram)
                ends = pa.array(np.searchsorted(docs, np.arange(high - low + 1)), pa.int32())
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("file"), part.column("row"), part.column("doc_id"), pa.array(sizes, pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(c)).hexdigest() for c in cut], pa.string()),
                        pa.ListArray.from_arrays(ends, pa.array(minis, pa.int64())),
                        pa.ListArray.from_arrays(ends, pa.array(starts, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    ],
                    ["file", "row", "doc_id", "n_words", "sha", "minis", "starts", "counts"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    given = placed.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    return given.mapInArrow(run, SCANNED)


def packed_pieces(wanted: DataFrame, width: int) -> DataFrame:
    """The words of each wanted super-k-mer of (file, row, text, hits) as one string, with the places that have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, bytes, list[dict]]] = {}
        count = 0
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("file", pa.int64()), ("row", pa.int64()), ("start", pa.int32())]))]

        def send() -> pa.RecordBatch:
            columns = [[v[0] for v in held.values()], list(held), [v[1] for v in held.values()], [v[2] for v in held.values()]]
            arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["mini", "digest", "packed", "places"])

        for batch in batches:
            for file, row, text, hits in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "text", "hits")), strict=True):
                words = text.encode().split()
                for hit in hits:
                    start = hit["start"]
                    packed = b" ".join(words[start : start + hit["count"] + width - 1])
                    digest = hashlib.blake2b(packed, digest_size=16).digest()
                    held.setdefault(digest, (hit["mini"], packed, []))[2].append({"file": file, "row": row, "start": start})
                    count += 1
                    if count % SENT == 0:
                        yield send()
        if held:
            yield send()

    return wanted.mapInArrow(run, PIECES)


def windows_of(packed: bytes, width: int) -> list[bytes]:
    """The windows of a packed string, as slices of it."""
    ends, at = [], -1
    for word in packed.split(b" "):
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [packed[starts[i] : ends[i + width - 1]] for i in range(len(ends) - width + 1)]


def repeated_masks(times: dict[bytes, int], width: int) -> dict[bytes, int]:
    """For packed strings of one bucket, each seen so many times: a bit for each window that stands in two places."""
    if len(times) == 1:
        (packed, count), = times.items()
        return {packed: (1 << packed.count(b" ") - width + 2) - 1 if count > 1 else 0}
    masks = dict.fromkeys(times, 0)
    entries = sorted((window, packed, i) for packed in times for i, window in enumerate(windows_of(packed, width)))
    at = 0
    while at < len(entries):
        end, total = at, 0
        while end < len(entries) and entries[end][0] == entries[at][0]:
            total += times[entries[end][1]]
            end += 1
        if total > 1:
            for _, packed, i in entries[at:end]:
                masks[packed] |= 1 << i
        at = end
    return masks


def bucket_masks(strings: DataFrame, width: int) -> DataFrame:
    """Repeated windows of buckets that one task can hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ["mini"]):
            times: Counter = Counter()
            for r in rows:
                times[r["packed"]] += r["times"]
            masks = repeated_masks(times, width)
            found = {r["digest"]: masks[r["packed"]] for r in rows if masks[r["packed"]]}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["digest", "mask"])

    return strings.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, MASKS)


def crowded_masks(strings: DataFrame, width: int) -> DataFrame:
    """The same of crowded buckets: equal strings counted, then the windows of the different ones as rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("digest", "packed", "times")]
            for low in range(0, batch.num_rows, 100):
                rows = [(d, t, i, w) for d, p, t in zip(*(c[low : low + 100] for c in columns), strict=True)
                        for i, w in enumerate(windows_of(p, width))]
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["digest", "times", "i", "window"]
                )

    different = store(strings.groupBy("digest", "packed").agg(F.sum("times").alias("times")))
    # A string that stands in two places repeats all its windows, whatever else they meet.
    often = different.where("times > 1").select("digest", F.expr(f"shiftleft(1L, {_windows(width)}) - 1").alias("mask"))
    windows = different.mapInArrow(run, "digest binary, times long, i int, window binary")
    again = windows.groupBy("window").agg(F.sum("times").alias("spots")).where("spots > 1")
    met = windows.where("times = 1").join(again, "window").groupBy("digest").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return often.unionByName(met)


def _windows(width: int) -> str:
    """SQL for the number of windows of `packed`."""
    return f"size(split(cast(packed as string), ' ')) - {width - 1}"


def remaining(texts: DataFrame, width: int) -> DataFrame:
    """(file, row, n_removed, kept_sha256) of (file, row, text, found), found the masks by start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas = [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                words = text.encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                for piece in found:
                    mask, start = piece["mask"], piece["start"]
                    for i in range(mask.bit_length()):
                        if mask >> i & 1:
                            edge[start + i] += 1
                            edge[start + i + width] -= 1
                gone = edge.cumsum()[:-1] > 0
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("row"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())],
                ["file", "row", "n_removed", "kept_sha256"],
            )

    return texts.mapInArrow(run, "file long, row long, n_removed long, kept_sha256 string")


def repeated_windows(
    placed: DataFrame, file: str, row: str, scanned: DataFrame, width: int, crowd: int
) -> tuple[DataFrame, DataFrame]:
    """(file, row, start, mask) of the super-k-mers with repeated windows, and the texts that can have any."""
    heads = scanned.select("file", "row", F.inline(F.arrays_zip("minis", "starts", "counts")).alias("mini", "start", "count"))
    repeated = store(scanned.select(F.explode("minis").alias("mini")).groupBy("mini").agg(F.count("*").alias("times")).where("times > 1"))
    hits = heads.join(repeated, "mini").groupBy("file", "row").agg(F.collect_list(F.struct("mini", "start", "count")).alias("hits"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = store(placed.select(F.col(file).alias("file"), F.col(row).alias("row"), text).join(hits, ["file", "row"]))
    pieces = store(packed_pieces(texts, width))
    strings = pieces.select("mini", "digest", "packed", F.size("places").cast("long").alias("times"))
    large = store(strings.groupBy("mini").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("mini"))
    if large.isEmpty():
        masks = bucket_masks(strings, width)
    else:
        few, many = strings.join(large, "mini", "left_anti"), strings.join(large, "mini", "left_semi")
        masks = bucket_masks(few, width).unionByName(crowded_masks(many, width))
    marked = pieces.select("digest", "places").join(masks, "digest").select("mask", F.inline("places"))
    return marked.select("file", "row", "start", "mask"), texts


def remove_repeats(docs: DataFrame, width: int = 35, gram: int = 8, crowd: int = 2_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, kept words joined by one space."""
    if not 1 <= gram <= width or width - gram > 61:
        raise ValueError("a super-k-mer's windows have to fit into the bits of a long")
    placed, file, row = located(docs)
    scanned = store(scan(placed, file, row, width, gram))
    masks, texts = repeated_windows(placed, file, row, scanned, width, crowd)
    found = masks.groupBy("file", "row").agg(F.collect_list(F.struct("start", "mask")).alias("found"))
    changed = remaining(texts.drop("hits").join(found, ["file", "row"]), width)
    return scanned.select("file", "row", "doc_id", "n_words", "sha").join(changed, ["file", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
