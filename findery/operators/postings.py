"""Term postings of a document frame.

A document's terms are counted where its tokens are cut, an Arrow batch at a time, so building postings gives a row per
distinct term and needs no shuffle. A text that several fields of a document hold is cut and counted once. Each batch counts
its documents by term too, so that a vocabulary adds up numbers of batches and not all postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions import fields as X, text as T
from findery.operators.forward import ForwardIndex, build_forward, read_forward
from findery.operators.match import term_keys
from findery.operators.terms import FALLBACK_FIELDS
from findery.rules import RuleSet
from findery.session import store
from findery.sources.indexes import searchable_name

KEYS = ["index_name", "field"]
#: Terms that may be broadcast.
BROADCAST_TERMS = 200_000


@dataclass(frozen=True)
class SearchIndex:
    """postings(index, field, term, doc_key, tf, doc_len, type), vocab(df), stats(n_docs, avg_len, is_searchable), and
    optionally what rules read of a document and the keys of the vocabulary. ``counted`` is set while the index is not kept:
    ``terms`` in pieces of a document, by ``fields``, all that hold a value, and with ``term_docs``, the documents of a batch that
    hold a term there, at one of them. ``counts`` are these numbers alone, where the vocabulary is not kept either."""

    postings: DataFrame
    vocab: DataFrame
    stats: DataFrame
    forward: ForwardIndex | None = None
    keys: DataFrame | None = None
    counted: DataFrame | None = None
    counts: DataFrame | None = None

    def vocab_of(self, terms: DataFrame) -> DataFrame:
        """The vocabulary of some different terms: where batches are added up, others are left out before."""
        asked = store(terms.select("term"))
        asked = asked.hint("broadcast" if asked.count() <= BROADCAST_TERMS else "merge")
        if self.counts is None:
            return self.vocab.join(asked, "term", "left_semi")
        return _vocab(self.counts.join(asked, "term", "left_semi"))

    def with_forward(self, docs: DataFrame, rules: RuleSet) -> SearchIndex:
        return replace(self, forward=build_forward(docs, rules))

    def write(self, path: str) -> None:
        """Kept as tables by index and field, so that a search reads only the fields it names."""
        self.postings.write.mode("overwrite").partitionBy(*KEYS).parquet(f"{path}/postings")
        kept = from_postings(self.postings.sparkSession.read.parquet(f"{path}/postings"))
        kept.vocab.write.mode("overwrite").partitionBy(*KEYS).parquet(f"{path}/vocab")
        kept.stats.write.mode("overwrite").parquet(f"{path}/stats")
        # Sorted by key, so that a file holds a range of keys and a reader skips the others by their bounds.
        keys = term_keys(self.postings.sparkSession.read.parquet(f"{path}/vocab"))
        keys.repartitionByRange("kind", "key").sortWithinPartitions("kind", "key").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/keys")
        if self.forward:
            self.forward.write(path)

    def stored(self, whole_vocab: bool = True) -> SearchIndex:
        """Written once to the shared folder: every use of it then reads tables, not documents.

        Without the ``whole_vocab``, which words matched exactly do not need, it is added up by those who ask.
        """
        forward = self.forward.stored() if self.forward else None
        if self.counted is None:
            derived = from_postings(store(self.postings))
            return SearchIndex(derived.postings, store(derived.vocab), store(derived.stats), forward)
        kept = store(self.counted)
        counts = kept.select("index_name", "fields", F.explode("terms").alias("t")).filter("t.term_docs > 0")
        counts = counts.select("index_name", "fields", "t.term", "t.term_docs")
        vocab = store(_vocab(counts)) if whole_vocab else _vocab(counts)
        firsts = kept.select("index_name", F.explode("fields").alias("field"), "doc_len", "is_first")
        return SearchIndex(_unpacked(kept), vocab, store(_stats(firsts)), forward, counts=None if whole_vocab else counts)


def _unpacked(counted: DataFrame) -> DataFrame:
    """Postings of what ``counted`` packs: one of each term and field."""
    each = counted.withColumn("field", F.explode("fields")).select("*", F.posexplode("terms").alias("at", "t"))
    first = F.col("is_first") & (F.col("at") == 0)
    return each.select(
        "index_name", "field", "doc_key", "index_type", "type_alias", "doc_len", "t.term", "t.tf", first.alias("is_first"))


def _vocab(counts: DataFrame) -> DataFrame:
    by_field = counts.select("index_name", F.explode("fields").alias("field"), "term", "term_docs")
    return by_field.groupBy(*KEYS, "term").agg(F.sum("term_docs").alias("df"))


def _stats(postings: DataFrame) -> DataFrame:
    """Each document's first posting stands for it and its length."""
    firsts = postings.filter("is_first").groupBy(*KEYS)
    n_docs = F.count(F.lit(1))
    stats = firsts.agg(n_docs.alias("n_docs"), (F.sum("doc_len") / n_docs).alias("avg_len"))
    return stats.withColumn("is_searchable", searchable_name(F.col("field")))


def from_postings(postings: DataFrame) -> SearchIndex:
    """Vocabulary and statistics counted from postings."""
    vocab = postings.groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("df"))
    return SearchIndex(postings, vocab, _stats(postings))


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    tables = [spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocab", "stats")]
    return SearchIndex(*tables, read_forward(spark, path), spark.read.parquet(f"{path}/keys"))


def indexed_fields(docs: DataFrame, names: list[str] | None = None, variants: bool = True) -> DataFrame:
    """(index, doc, type, fields, value): the node name and the stored fields, each different value once with all that hold it.

    With ``names``, only those fields and, with ``variants``, their culture variants. An empty list stands for every
    field that is searchable by its name.
    """
    own = F.struct(F.lit(X.NODE_NAME).alias("key"), F.col("name").alias("value"))

    def held(wanted: Callable[[Column], Column]) -> Column:
        """The filled stored fields whose name is wanted; the node name is the document's own."""
        fields = F.map_filter("fields", lambda k, v: wanted(k) & (k != X.NODE_NAME) & v.isNotNull())
        return F.map_entries(fields)

    if names is None:
        entries = F.concat(F.array(own), held(lambda k: F.lit(True)))
    elif not names:
        entries = F.concat(F.array(own), held(lambda k: searchable_name(k) | k.isin(*FALLBACK_FIELDS)))
    else:
        lowered = sorted({n.lower() for n in names})
        plain = [n for n in lowered if n != X.NODE_NAME]
        # A field asked for by name is looked up; only culture variants need every key of the map.
        found = [F.struct(F.lit(n).alias("key"), X.stored(n).alias("value")) for n in plain]
        entries = F.array(*([own] if X.NODE_NAME in lowered else []), *found)
        if variants:
            def variant(key: Column) -> Column:
                match = F.lit(False)
                for name in lowered:
                    match = match | key.startswith(name + "_")
                return match & ~key.isin(*plain) if plain else match

            entries = F.concat(entries, held(variant))
    def by_value(filled: Column) -> Column:
        values = F.array_distinct(F.transform(filled, lambda e: e["value"]))
        return F.transform(values, lambda v: F.struct(
            F.transform(F.filter(filled, lambda e: e["value"] == v), lambda e: e["key"]).alias("fields"), v.alias("value"),
        ))

    held_once = T.let(F.filter(entries, lambda e: e["value"].isNotNull()), by_value)
    return docs.select("index_name", "index_type", "type_alias", "doc_key", F.inline(held_once).alias("fields", "value"))


POSTINGS = (
    "index_name string, field string, doc_key string, index_type string, type_alias string, doc_len int, term string, "
    "tf int, is_first boolean"
)
#: What tasks give: at most so many terms of a value a row, so that readers of many rows at once stay small.
PIECE = 256
COUNTED = (
    "index_name string, fields array<string>, doc_key string, index_type string, type_alias string, doc_len int, is_first boolean, "
    "terms array<struct<term: string, tf: int, term_docs: int>>"
)


@dataclass(frozen=True)
class _Terms:
    """A batch's different terms by row: each row's size, then for every posting its row, term code and count, and the terms."""

    sizes: np.ndarray
    row: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    terms: pa.Array

    def by_group(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(first posting, postings) of each term of each index and list of fields."""
        place: dict[tuple, int] = {}
        names, fields = batch.column("index_name").to_pylist(), batch.column("fields").to_pylist()
        group = np.array([place.setdefault((n, *f), len(place)) for n, f in zip(names, fields, strict=True)], np.int64)
        _, first, count = np.unique(group[self.row] * len(self.terms) + self.code, return_index=True, return_counts=True)
        return first, count


def _count_terms(batch: pa.RecordBatch) -> _Terms:
    """Terms of rows with their ``words``, parted by single spaces: equal (row, term) codes are counted as one sorted array."""
    lists = pc.split_pattern(batch.column("words"), " ")
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    codes, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    real = codes != pc.index(coded.dictionary, "").as_py()
    codes, row = codes[real], row[real]
    width = max(len(coded.dictionary), 1)
    kept, tf = np.unique(row * width + codes, return_counts=True)
    return _Terms(np.bincount(row, minlength=len(sizes)), kept // width, kept % width, tf, coded.dictionary)


def _postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _count_terms(batch)
        if not len(found.row):
            continue
        docs = np.zeros(len(found.row), np.int32)
        first, count = found.by_group(batch)
        docs[first] = count
        each = np.bincount(found.row, minlength=batch.num_rows)
        pieces = -(-each // PIECE)
        row = np.repeat(np.arange(batch.num_rows), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.append((np.cumsum(each) - each)[row] + PIECE * number, len(found.row))
        packed = [found.terms.take(pa.array(found.code)), pa.array(found.tf, pa.int32()), pa.array(docs)]
        columns = {
            **{c: batch.column(c).take(pa.array(row)) for c in ("index_name", "fields", "doc_key", "index_type", "type_alias")},
            "doc_len": pa.array(found.sizes[row], pa.int32()), "is_first": pa.array(number == 0),
            "terms": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(packed, ["term", "tf", "term_docs"])),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = _count_terms(batch)
        if not len(found.row):
            continue
        first, count = found.by_group(batch)
        columns = {
            **{c: batch.column(c).take(pa.array(found.row[first])) for c in ("index_name", "fields")},
            "term": found.terms.take(pa.array(found.code[first])), "term_docs": pa.array(count, pa.int32()),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def build_postings(docs: DataFrame, names: list[str] | None = None, variants: bool = True) -> SearchIndex:
    """Postings, vocabulary and field statistics; tokens are lower-case letter/digit runs.

    The vocabulary comes from counts of batches, so one that is asked for alone needs no postings.
    """
    rows = indexed_fields(docs, names, variants)
    worded = rows.select("index_name", "fields", "doc_key", "index_type", "type_alias", T.spaced_tokens(F.col("value")).alias("words"))
    counted = worded.mapInArrow(_postings, COUNTED)
    counts = worded.mapInArrow(_term_counts, "index_name string, fields array<string>, term string, term_docs int")
    postings = _unpacked(counted)
    return SearchIndex(postings, _vocab(counts), _stats(postings), counted=counted, counts=counts)
