"""Near duplicates by MinHash banding, checked on full sets of word n-grams.

1. A text's words (lower-cased runs of letters, digits and underscores) give its set of five-word
   shingles; a text of one to four words is one shingle, a text without words has none and no links.
   Texts of one set are one node, named by the set's digest.
2. Every set gets a MinHash signature, cut into bands. Bands and rows are chosen for a target recall at
   the threshold. Nodes are shuffled on their band hashes, a minimum a bucket ties its nodes together,
   and nodes so connected, directly or not, form one candidate group.
3. Each candidate's text is read once more and sent to its group. A group of many nodes is dealt into
   blocks by hash, and each pair of blocks is one piece of work, so no task holds more than two blocks
   whatever the group's size. A piece counts shared shingles of all its pairs at once, as products of
   0/1 matrices, and gives no pairs out: only each node's number of links and the links of a spanning
   forest, which lose no connection.
4. Linked nodes are connected to classes.

The pair work of a group grows with the square of its different sets, which exact link counts need; copies
of one set, however many, are one node. Null texts are empty; null doc_ids and repeated rows are
kept as rows; other columns are ignored; texts of any length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.common import Memo, grouped, located, slices, without
from findery.llm.components import components
from findery.session import store

WORDS = re.compile(r"\w+")
SIGNED = "file long, row long, doc_id long, node string, size int, bands array<long>"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): of those that find a pair at the threshold with the wanted probability within `most`
    hashes, the ones with the most rows, as they meet the fewest other pairs."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold**rows < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no bands within {most} hashes reach a recall of {recall}")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


@lru_cache(maxsize=1)
def word_hashes() -> Memo:
    return Memo(lambda words: [word_hash(w) for w in words])


def shingle_sets(many: list[str], n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles."""
    out = []
    for hashes in word_hashes().lookup([WORDS.findall(t.lower()) for t in many]):
        h = np.array(hashes, np.uint64)
        width = min(n, len(h))
        if not width:
            out.append(h)
            continue
        count = len(h) - width + 1
        total = np.full(count, width, np.uint64)
        for i in range(width):
            total = mix(total * _ODD[i % 5] + h[i : i + count])
        out.append(np.unique(total))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes of sets that are not empty, one row each."""
    rng = np.random.default_rng(20)
    mult = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for i in range(band * rows, (band + 1) * rows):
            key = mix(key * _ODD[0] + np.minimum.reduceat(flat * mult[i] + add[i], starts))
        out[:, band] = key
    return out.view(np.int64)


def signed(placed: DataFrame, file: str, row: str, bands: int, rows: int, n: int) -> DataFrame:
    """Each row's node and band hashes; rows without words have the node ''."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text").to_pylist(), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                marks: list = [[]] * len(sets)
                if full:
                    for i, mark in zip(full, signatures([sets[i] for i in full], bands, rows).tolist(), strict=True):
                        marks[i] = mark
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else "" for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("file"), part.column("row"), part.column("doc_id"), pa.array(nodes, pa.string()),
                        pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.list_(pa.int64())),
                    ],
                    ["file", "row", "doc_id", "node", "size", "bands"],
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    given = placed.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text)
    return given.mapInArrow(run, SIGNED)


def candidate_groups(nodes: DataFrame) -> DataFrame:
    """(node, root) of the nodes that share a band hash with another one, directly or through others."""
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    ties = banded.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    links = banded.join(ties.drop("most"), ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    return components(links)


def linked(sets: list[np.ndarray], threshold: float, columns: int = 4096) -> np.ndarray:
    """Whether each pair of sets reaches the threshold: shared items are counted as products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    items, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(at, minlength=len(items)) > 1  # an item of one set is shared by none
    place = np.cumsum(often) - 1
    used = often[at]
    owner, at = owner[used], place[at[used]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), columns):
        low, high = np.searchsorted(at, [start, start + columns])
        block = np.zeros((len(sets), min(columns, int(often.sum()) - start)), np.float32)
        block[owner[low:high], at[low:high] - start] = 1
        shared += block @ block.T
    # Counts below 2**24 are exact; shared / union >= threshold, without a division.
    union = sizes[:, None] + sizes[None, :] - shared
    found = shared >= threshold * union - 1e-9
    np.fill_diagonal(found, False)
    return found


def forest(found: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, its tree's first node) with the same connections as the matrix."""
    first, seen = [], np.zeros(len(found), bool)
    for start in range(len(found)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            new = np.flatnonzero(found[queue.pop()] & ~seen)
            seen[new] = True
            queue.extend(new.tolist())
            first += [(int(i), start) for i in new]
    return first


def pair_work(texts_of: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, links, tied) of pieces of work: rows sorted by piece, each a candidate's node, block and text.
    A pair within one block counts in the piece of that block with itself alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in grouped(batches, ["root", "low", "high"]):
            if len(rows) < 2:
                continue
            names, blocks = [r["node"] for r in rows], np.array([r["block"] for r in rows])
            found = linked(shingle_sets([r["text"] for r in rows], n), threshold)
            if low != high:
                found &= blocks[:, None] != blocks[None, :]
            links, tied = found.sum(1), dict(forest(found))
            out = [i for i in range(len(names)) if links[i]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in out], pa.string()), pa.array([int(links[i]) for i in out], pa.int64()),
                    pa.array([names[tied[i]] if i in tied else None for i in out], pa.string()),
                ],
                ["node", "links", "tied"],
            )

    return texts_of.mapInArrow(run, "node string, links long, tied string")


def classes(placed: DataFrame, file: str, row: str, threshold: float, recall: float, n: int, block: int) -> DataFrame:
    """Every row's (file, row, doc_id, node, root, links); root is null where a row's node has no link."""
    bands, rows = choose_bands(threshold, recall)
    marked = store(signed(placed, file, row, bands, rows, n))
    filled = marked.where("size > 0")
    nodes = filled.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.first("bands").alias("bands")
    )
    groups = store(candidate_groups(nodes.select("node", "bands")))
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # One row of each candidate stands for its set.
    place = filled.groupBy("node").agg(F.min(F.struct("file", "row")).alias("at"))
    wanted = (
        groups.join(sizes, "root").join(place, "node")
        .select("node", "root", "blocks", F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = placed.select(F.col(file).alias("file"), F.col(row).alias("row"), text)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        wanted.join(texts, ["file", "row"]).withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "block", "text")
    )
    keys = ["root", "low", "high"]
    work = store(pair_work(dealt.repartition(*keys).sortWithinPartitions(*keys), threshold, n))
    ties = components(work.where("tied is not null").select(F.col("node").alias("a"), F.col("tied").alias("b")))
    counts = work.groupBy("node").agg(F.sum("links").alias("links"))
    known = ties.join(counts, "node").select("node", "root", "links")
    return marked.select("file", "row", "doc_id", "node").join(known, "node", "left")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, n: int = 5, block: int = 256
) -> tuple[DataFrame, DataFrame, str, str]:
    """Every row's (file, row, doc_id, class_id, n_links, representative), and docs with its locators.

    class_id is the smallest doc_id of the connected texts, null if all their ids are null;
    n_links counts the different shingle sets that are similar to the row's own; representative is true for one
    row of each class: the smallest doc_id (null last), then the first by locator. A row without words
    is alone, whatever other rows are.
    """
    placed, file, row = located(docs)
    found = store(classes(placed, file, row, threshold, recall, n, block))
    alone = F.concat_ws(":", F.lit("row"), "file", "row")
    group = F.when(F.col("node") == "", alone).otherwise(F.coalesce("root", "node"))
    found = found.withColumn("group", group)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("file"), F.col("row"))
    best = found.groupBy("group").agg(F.min(order).alias("best"))
    first = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
    out = found.join(best, "group").select(
        "file", "row", "doc_id", F.col("best.doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), first.alias("representative"),
    )
    return out, placed, file, row


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, columns as they were."""
    found, placed, file, row = near_duplicates(docs)
    return without(placed, file, row, found.where("not representative"), docs.columns)
