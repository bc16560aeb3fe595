"""Vector codes: parts of a vector coded by the nearest of a small codebook, searched with LAESA pivots.

Every component becomes an integer, a vector is cut into equal parts, and each part position has a codebook
that rounds of assignment and averaging move. Distances from each part to a few fixed pivots are computed once
and kept with the vector. In a round only the pivots' distances to the entries are new; by the triangle
inequality the two give a lower bound for every entry. Entries are tried in the order of their bounds, with exact
integers, until the next bound exceeds the best distance found. A bound that equals it is still tried, so ties
go to the lower index.

A codebook has a fixed size, whatever the table's: tasks add up their parts by entry, Spark adds the sums, and the
driver sees one number for each entry and component. Vectors are prepared and written once; each round reads them.

Left out: vectors that are null or empty, hold a null or a component that is not finite, differ in length from the first
one kept, or hold a component beyond 2**15, as their sums would not fit into a long. A length that the
parts do not divide is filled up with zeros. "First" is by vec_id (null last), then by the vector itself;
fewer vectors than entries give that many entries. Repeated rows are rows of their own; null labels are one
label; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.session import store

#: Larger components are left out: 2**15 * 4096 squared, times any common length, still fits into a long.
LARGEST = 2.0**15


def kept_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vector, label) of the vectors that can be coded, of any length."""
    vector = F.col("embedding").cast("array<double>")
    # A comparison with null or NaN is not true in `abs(x) < LARGEST`: NaN is larger than any number.
    sound = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(LARGEST), F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), "label").where(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & sound
    )


def integers(vectors: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """(row, part, position) of a list array whose rows all have `width` components."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)
    whole = np.floor(flat * scale).astype(np.int64)
    fill = -width % parts
    if fill:
        whole = np.pad(whole, ((0, 0), (0, fill)))
    return whole.reshape(len(whole), parts, -1)


def spread_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Of a part position's first entries, `count` that lie far apart: the first, then always the one farthest
    from those taken (ties: the lower index)."""
    taken = [0]
    while len(taken) < min(count, len(entries)):
        gaps = entries[:, None, :] - entries[None, taken, :]
        taken.append(int((gaps * gaps).sum(2).min(1).argmax()))
    return entries[taken]


def roots(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (row, pivot) of the parts of one position."""
    gaps = parts[:, None, :] - pivots[None, :, :]
    return np.sqrt((gaps * gaps).sum(2).astype(np.float64))


def nearest(parts: np.ndarray, book: np.ndarray, known: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, and how many exact distances that took.

    `known` holds the parts' distances to the pivots as 32-bit floats; the slack is above their rounding.
    """
    fixed = roots(pivots, book)
    apart = np.abs(known[:, :, None].astype(np.float64) - fixed[None])
    slack = 1e-6 * (known[:, :, None] + fixed[None]) + 1e-6
    low = np.maximum((apart - slack).max(1), 0.0) ** 2
    order = np.argsort(low, axis=1, kind="stable")
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), len(book))
    alive, tried = np.arange(len(parts)), 0
    for rank in range(len(book)):
        entry = order[alive, rank]
        open_ = low[alive, entry] <= best[alive]
        alive, entry = alive[open_], entry[open_]
        if not len(alive):
            break
        gap = parts[alive] - book[entry]
        distance = (gap * gap).sum(1)
        tried += len(alive)
        better = (distance < best[alive]) | ((distance == best[alive]) & (entry < index[alive]))
        best[alive[better]], index[alive[better]] = distance[better], entry[better]
    return index, best, tried


def prepared(kept: DataFrame, width: int, pivots: list[np.ndarray], scale: int) -> DataFrame:
    """(vec_id, label, whole, known): integer components, and distances to each position's pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = integers(batch.column("vector"), width, len(pivots), scale)
            known = np.stack([roots(whole[:, p], pivots[p]) for p in range(len(pivots))], 1).astype(np.float32)
            rows = len(whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _lists(whole.astype(np.int32), rows), _lists(known, rows)],
                ["vec_id", "label", "whole", "known"],
            )

    label = kept.schema["label"].dataType.simpleString()
    return kept.where(F.size("vector") == width).mapInArrow(
        run, f"vec_id long, label {label}, whole array<int>, known array<float>"
    )


def _lists(values: np.ndarray, rows: int) -> pa.ListArray:
    flat = values.reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (len(flat) // rows if rows else 0)), pa.array(flat))


def assigned(batch: pa.RecordBatch, books: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole, index, distance) by row and part of prepared rows."""
    rows, parts = batch.num_rows, len(books)
    whole = batch.column("whole").flatten().to_numpy().astype(np.int64).reshape(rows, parts, -1)
    known = batch.column("known").flatten().to_numpy().reshape(rows, parts, -1)
    found = [nearest(whole[:, p], books[p], known[:, p], pivots[p]) for p in range(parts)]
    return whole, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(table: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each used entry is its parts' floor mean by component."""
    parts, entries, size = len(books), len(books[0]), books[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column of each entry counts its parts.
        total = np.zeros((parts * entries, size + 1), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, index, _ = assigned(batch, books, pivots)
            slot = index + np.arange(parts) * entries
            np.add.at(total[:, :size], slot.reshape(-1), whole.reshape(-1, size))
            total[:, size] += np.bincount(slot.reshape(-1), minlength=parts * entries)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.reshape(-1)[cell], pa.int64())], ["cell", "total"])

    sums = table.mapInArrow(run, "cell int, total long").groupBy("cell").agg(F.sum("total").alias("total"))
    total = np.zeros(parts * entries * (size + 1), np.int64)
    for cell, value in sums.collect():
        total[cell] = value
    total = total.reshape(parts, entries, size + 1)
    count = total[:, :, size:]
    return list(np.where(count > 0, total[:, :, :size] // np.maximum(count, 1), np.stack(books)))


def coded(table: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of prepared rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, index, distance = assigned(batch, books, pivots)
            codes = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes), pa.array(distance.sum(1), pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def fitted(rows: DataFrame, parts: int, entries: int, rounds: int, pivots: int, scale: int) -> tuple[DataFrame, list, list] | None:
    """The prepared vectors, their codebooks and pivots; None if there are no vectors."""
    kept = kept_vectors(rows)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vec_id", "vector")
    lead = first.limit(1).collect()
    if not lead:
        return None
    width = len(lead[0].vector)
    start = pa.array([r.vector for r in first.where(F.size("vector") == width).limit(entries).collect()], pa.list_(pa.float64()))
    whole = integers(start, width, parts, scale)
    books = [whole[:, p] for p in range(parts)]
    fixed = [spread_pivots(b, pivots) for b in books]
    table = store(prepared(kept, width, fixed, scale))
    for _ in range(rounds):
        books = moved(table, books, fixed)
    return table, books, fixed


def vector_codes(
    rows: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, pivots: int = 4, scale: int = 4096
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector kept.

    `code` has two hexadecimal digits a part; `error` is the squared distance to the coded vector, `label_error` its sum
    over the rows of the same label, and the checksum is of the final entries' components.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits: between 1 and 256 entries")
    found = fitted(rows, parts, entries, rounds, pivots, scale)
    if found is None:
        return rows.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    table, books, fixed = found
    codes = store(coded(table, books, fixed))
    text = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "same")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256")
    )
