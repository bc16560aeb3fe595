"""Token ids as ORC files: run-length encoded integers, row indexes, and Bloom filters on document ids.

Rows lie in ascending doc_id order, nulls first. A file's rows carry their shard, and where their ids
start within the shard; those columns and the list lengths cost next to nothing, as ORC stores runs of
equal or evenly growing integers as runs. Where a shard starts in the whole follows from one sum a
shard, so no pass over all rows is needed to place a document. Readers split files by stripe, and a
lookup by doc_id skips stripes and row groups by their ranges and Bloom filters.

One shuffle orders the raw texts by range; encoding runs after it, once. A null text is an empty one and
has the end id alone; repeated doc_ids are all kept, in the order of their texts, and equal rows lie side by side; texts of any
length are one row of ids; other columns are ignored; an empty table gives files without rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findery.llm.byte_bpe import byte_characters
from findery.llm.common import Memo, cut_words, spread, texts

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens int, ids array<int>"

#: Of the writer: a stripe is the piece that one reader takes, a row group the piece that an index can skip.
OPTIONS = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


#: ASCII punctuation but the apostrophe, which may start a pre-token of its own.
EDGES = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def parted(word: bytes) -> tuple[bytes, bytes]:
    """A word and the punctuation behind it. The tokenizer parts them as well, where a letter or digit stands before it."""
    core = word.rstrip(EDGES)
    if len(core) == len(word) or not core:
        return word, b""
    if core[-1:].isalnum():
        return core, word[len(core) :]
    # Of other letters only Latin ones whose lower case is one letter: a capital may become a letter and a mark.
    last = core[-4:].decode("utf-8", "ignore")[-1:]
    if last.isalpha() and "\x80" <= last < "\u0250" and len(last.lower()) == 1:
        return core, word[len(core) :]
    return word, b""


class WordIds:
    """The tokenizer's ids by word. Its normaliser and splitter never join anything across ASCII white
    space, so a text's ids are those of its words one after another, and a word's are those of its parts."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.chars = dict(enumerate(byte_characters()))
        self.memo = Memo(self._encode)

    def _is_plain(self, word: str) -> bool:
        """Whether the normaliser leaves the word as it is and the splitter makes it one pre-token: Latin letters in lower case."""
        return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and word.lower() == word and is_normalized("NFC", word)))

    def _encode(self, words: list[bytes]) -> Iterator[bytes]:
        """Plain words go to the tokenizer's model, as its byte-level step writes them; others through the whole tokenizer."""
        text = [w.decode() for w in words]
        plain = [self._is_plain(w) for w in text]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(text, plain, strict=True) if not p], add_special_tokens=False))
        model = self.tokenizer.model
        for raw, is_plain in zip(words, plain, strict=True):
            if is_plain:
                ids = [t.id for t in model.tokenize(raw.decode("latin-1").translate(self.chars))]
            else:
                ids = next(rest).ids
            yield array("I", ids).tobytes()

    def encode(self, given: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids a text, all ids). Only a batch's different words are looked up, in parts; ids are then taken by word.

        Lower-casing A-Z early changes no id, as the normaliser does it too, and leaves fewer words."""
        sizes, codes, words = cut_words(given, lower=True)
        parts = list(map(parted, words))
        heads, tails = self.memo.lookup([[p[0] for p in parts], [p[1] for p in parts]])
        return spread(list(map(bytes.__add__, heads, tails)), codes, sizes, "<u4")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of SCHEMA in ascending doc_id order: each text's ids with the end id behind them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, start = TaskContext.get().partitionId(), 0
        coder = word_ids(tokenizer)
        for batch in batches:
            counts, ids = coder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, np.uint32(end_id)).view(np.int32)
            sizes = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(batch.num_rows, shard), pa.int32()),
                    pa.array(sizes[:-1] + start, pa.int64()),
                    pa.array(np.diff(sizes), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(ids)),
                ],
                ["doc_id", "shard", "shard_start", "n_tokens", "ids"],
            )
            start += int(sizes[-1])

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    encode(docs, tokenizer, end_id).write.options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`, the number of ids of all documents before: doc_id, start, n_tokens, ids.

    A filter on doc_id reaches the scan, which skips stripes and row groups by it.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    # A row a file, each of a task's size: the driver has listed as many before, so it may be broadcast.
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"), "ids",
    )


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows that read_tokens gave; the checksum is of the ids as
    little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4").data.cast("B"), ids.offsets.to_numpy() * 4
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
