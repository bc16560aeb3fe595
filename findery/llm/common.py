"""What the training-data operators share: inputs of fixed shape, row locators, caches and grouped batches."""

from __future__ import annotations

import sys
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery import session

#: Arrow batches are bounded by rows and by bytes, so that long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def configure(spark: SparkSession) -> SparkSession:
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    # Intermediate tables are mostly text.
    spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, *more): other columns of any name are left behind; a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(frame: DataFrame) -> tuple[DataFrame, str, str]:
    """The frame with two columns that tell its rows apart for good: a hash of the file's path and the
    row's place in that file. A frame that is not read from Parquet files is written to the shared
    folder first. Returns the frame and the two names."""
    file, row = fresh(frame, "at_file"), fresh(frame, "at_row")
    try:
        place = frame.metadataColumn("_metadata")
        return frame.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row)), file, row
    except AnalysisException:
        return located(session.store(frame))


def without(placed: DataFrame, file: str, row: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of a located frame whose place is not among (file, row) of `gone`, in the given columns."""
    gone = gone.select(F.col("file").alias(file), F.col("row").alias(row))
    return placed.join(gone, [file, row], "left_anti").select(*[placed[c] for c in columns])


class _Known(dict):
    """A dictionary that notes the keys it is asked for in vain."""

    def __init__(self) -> None:
        super().__init__()
        self.asked: list = []

    def __missing__(self, key):
        self.asked.append(key)


class Memo:
    """Results by word, kept while there is room. `build` gives the results of sorted new words.

    All caches of a worker share one budget of bytes (`room`). Workers are used again by later stages, so a cache that
    needs room first takes that of the one which has been idle for longest.
    """

    room = 200_000_000
    #: A dictionary's own bytes an entry, at its emptiest.
    ENTRY = 110
    _clock = 0
    _live: weakref.WeakSet[Memo] = weakref.WeakSet()

    def __init__(self, build: Callable[[list], Iterable]) -> None:
        self.build = build
        self.known = _Known()
        self.held = self.used = 0
        Memo._live.add(self)

    def __reduce__(self):
        return Memo, (self.build,)

    def clear(self) -> None:
        self.known.clear()
        self.held = 0

    def _make_room(self, more: int) -> bool:
        free = Memo.room - sum(m.held for m in Memo._live) - more
        for other in sorted(Memo._live, key=lambda m: m.used):
            if free >= 0:
                break
            free += other.held
            other.clear()
        return free >= 0

    def lookup(self, cut: list[list]) -> list[list]:
        """The results of each list's words; none of them may be None."""
        Memo._clock += 1
        self.used = Memo._clock
        known, asked, found, short = self.known, self.known.asked, [], []
        for i, words in enumerate(cut):
            before = len(asked)
            found.append(list(map(known.__getitem__, words)))
            if len(asked) > before:
                short.append(i)
        if short:
            new = sorted(set(asked))
            asked.clear()
            built = dict(zip(new, self.build(new), strict=True))
            for i in short:
                found[i] = [built[w] if value is None else value for w, value in zip(cut[i], found[i], strict=True)]
            more = sum(map(sys.getsizeof, built)) + sum(map(sys.getsizeof, built.values())) + Memo.ENTRY * len(built)
            if self._make_room(more):
                known.update(built)
                self.held += more
        return found


def cut_words(given: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(words a text, code of each word, word by code) of texts cut at ASCII white space, with A-Z lower-cased if
    wanted. Codes hold for these texts alone; a code may be of an empty word that no text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(given) if lower else given)
    sizes = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes, blank = coded.indices.to_numpy(), pc.index(coded.dictionary, "").as_py()
    if blank >= 0:
        real = codes != blank
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        codes = codes[real]
    return sizes, codes, coded.dictionary.cast(pa.binary()).to_pylist()


def spread(values: list[bytes], codes: np.ndarray, sizes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(items a text, all items) where values[code] holds a word's items as bytes of numbers of a kind."""
    flat = np.frombuffer(b"".join(values), kind)
    ends = np.cumsum([0, *(len(v) // flat.itemsize for v in values)])
    own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
    each = np.concatenate([[0], np.cumsum(np.diff(ends)[codes])])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return np.diff(each[at]), own.take(pa.array(codes)).flatten().to_numpy()


def slices(batch: pa.RecordBatch, rows: int = 200) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The groups of batches that come sorted by the keys, one group in memory at a time."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows
