"""Scoring: BM25 over matched postings, word and field operators, and the fetch window.

Words are weighed once a document, however many queries hold them; a document's weights then meet the queries where the
document lies, so rows of query, document and word are never shuffled or kept. Postings of frequent terms stay where they are, and
of all terms that a word matches in a piece of a document only the best weight goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from findery.operators.forward import PLACE
from findery.operators.rank import first_rows
from findery.session import store

K1, B = 1.2, 0.75
#: Matched terms that may be broadcast, and query words that a task may hold. More of them are joined by shuffles.
BROADCAST_TERMS, HELD_WORDS = 200_000, 1_000_000
#: Words of queries that documents are expanded to at a time, and matched words that are reduced at a time.
EXPANDED, REDUCED = 1_000_000, 400_000
#: Scores are rounded to six places afterwards, so ones this far apart stay in order.
APART = 2e-6


def bm25(tf: Column, df: Column, n_docs: Column, doc_len: Column, avg_len: Column) -> Column:
    """Robertson and Zaragoza's BM25 with k1 = 1.2 and b = 0.75."""
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def posting_matches(matches: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """Matched terms joined to their postings, with a weight per word and document.

    The matched terms are written first, so their size is known: few bytes are broadcast and the postings
    stay where they are; with more, adaptive execution splits the partitions of a word that many documents
    hold.
    """
    informed = store(matches.join(stats, ["index_name", "field"]))
    if informed.count() > BROADCAST_TERMS:
        # Repeated values make files far smaller than the rows in a driver's memory.
        informed = informed.hint("merge")
    joined = postings.join(informed, ["index_name", "field", "term"])
    weight = bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))
    kept = [c for c in matches.columns if c not in ("term", "df")]
    return joined.select(*kept, "doc_key", weight.alias("weight"))


def document_weights(matches: DataFrame, postings: DataFrame, stats: DataFrame, held_words: Broadcast) -> DataFrame:
    """(index_name, doc_key, words, weights): a row a document, with the places of its words among the held ones.

    A matched term has one row with its words. The most frequent terms, ``BROADCAST_TERMS`` words at most, are broadcast to the postings,
    so that of many terms only the postings of rare ones are shuffled to meet them. A word may come several times, once for each
    piece of the document.
    """
    keys = ["index_name", "field", "term"]
    by_term = matches.groupBy(*keys, "df").agg(F.collect_list("word_no").alias("words"))
    informed = store(by_term.join(stats.select("index_name", "field", "n_docs", "avg_len"), ["index_name", "field"]))
    # A row for each different count of documents, of which there are few.
    sizes = sorted(((r.df, r.n) for r in informed.groupBy("df").agg(F.sum(F.size("words")).alias("n")).collect()), reverse=True)
    ends = np.cumsum([n for _, n in sizes])
    held = int(np.searchsorted(ends, BROADCAST_TERMS, "right"))
    weight = bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))

    def weighed(rows: DataFrame, terms: DataFrame) -> DataFrame:
        return rows.join(terms, keys).select("index_name", "doc_key", "words", weight.alias("weight"))

    if held == len(sizes):
        found = weighed(postings, informed.hint("broadcast"))
    elif held == 0:
        found = weighed(postings, informed.hint("merge"))
    else:
        often = F.col("df") >= sizes[held - 1][0]
        frequent = informed.filter(often)
        others = postings.join(frequent.select(*keys).hint("broadcast"), keys, "left_anti")
        found = weighed(postings, frequent.hint("broadcast")).unionByName(weighed(others, informed.filter(~often).hint("merge")))
    reduced = found.mapInArrow(_reducer(held_words, REDUCED), "index_name string, doc_key string, words array<int>, weights array<double>")
    every = [F.flatten(F.collect_list(c)).alias(c) for c in ("words", "weights")]
    return reduced.groupBy("index_name", "doc_key").agg(*every)


def _reducer(held_words: Broadcast, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best weight of each word in each document, of about ``most`` words at a time."""

    def reduce(table: pa.Table, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        lists = table["words"].combine_chunks()
        times = lists.value_lengths().to_numpy()
        doc = np.zeros(len(table), np.int64)
        for name in ("index_name", "doc_key"):
            codes = table[name].combine_chunks().dictionary_encode("encode")
            doc = doc * max(len(codes.dictionary), 1) + codes.indices.to_numpy()
        _, first, number = np.unique(doc, return_index=True, return_inverse=True)
        key = np.repeat(number.reshape(-1), times) * len(ids) + np.searchsorted(ids, lists.flatten().to_numpy())
        order = np.argsort(key)
        key = key[order]
        starts = _runs(key)
        best = np.maximum.reduceat(np.repeat(table["weight"].to_numpy(), times)[order], starts) if len(starts) else np.zeros(0)
        at, word = np.divmod(key[starts], max(len(ids), 1))
        ends = pa.array(np.searchsorted(at, np.arange(len(first) + 1)), pa.int32())
        columns = {c: table[c].combine_chunks().take(pa.array(first)) for c in ("index_name", "doc_key")}
        columns["words"] = pa.ListArray.from_arrays(ends, pa.array(word, pa.int32()))
        columns["weights"] = pa.ListArray.from_arrays(ends, pa.array(best))
        yield from pa.table(columns).to_batches(max_chunksize=1_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, size = held_words.value["ids"], [], 0
        for batch in batches:
            parts.append(batch)
            size += len(batch.column("words").flatten())
            if size >= most:
                yield from reduce(pa.Table.from_batches(parts), ids)
                parts, size = [], 0
        if parts:
            yield from reduce(pa.Table.from_batches(parts), ids)

    return run


def match_all_terms(matches: DataFrame, require_all: bool) -> DataFrame:
    """Per document, field and rule: the best variant of each word, summed.

    With ``require_all`` every word of the query must have matched in the field.
    """
    field_keys = ["query_id", "index_name", "doc_key", "field", *[c for c in ("rule_no",) if c in matches.columns]]
    carried = [F.first(c).alias(c) for c in ("n_groups", "n_fields", "boost") if c in matches.columns]
    best = matches.groupBy(*field_keys, "group_no").agg(F.max("weight").alias("weight"), *carried)
    per_field = best.groupBy(*field_keys).agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("groups_matched"), *carried
    )
    return per_field.filter("groups_matched >= n_groups") if require_all else per_field


def match_field_operator(matches: DataFrame, op: str = "or") -> DataFrame:
    """Per document: scores of fields and rules times their boost, summed; ``and`` needs every one of them."""
    grouped = matches.groupBy("query_id", "index_name", "doc_key").agg(
        F.round(F.sum(F.col("boost") * F.col("weight")), 6).alias("raw_score"),
        F.count(F.lit(1)).alias("fields_matched"), F.first("n_fields").alias("n_fields"),
    )
    kept = grouped.filter("fields_matched >= n_fields") if op == "and" else grouped
    return kept.select("query_id", "index_name", "doc_key", "raw_score")


def asked_by(words: DataFrame) -> list[str]:
    """What tells how a word is asked for; words of several fuzzinesses hold their own."""
    return ["index_name", "field", "match_mode", *[c for c in ("fuzziness",) if c in words.columns]]


def numbered_words(words: DataFrame) -> DataFrame:
    """The different words that are asked for in a field and mode, with a number each."""
    asked = words.select(*asked_by(words), F.lower("variant").alias("variant")).distinct()
    return store(asked.withColumn("word_no", F.monotonically_increasing_id()))


def _held_words(words: DataFrame) -> dict[str, np.ndarray | pa.Array]:
    """Query words by their number. Groups are numbered by query, field and rule, so that sums run over neighbours."""
    table = words.toArrow()
    ids = {c: np.unique(table[c].to_numpy(), return_inverse=True)[1] for c in ("index_name", "field", "rule_no", "group_no")}
    query_values = table["query_id"].combine_chunks().dictionary_encode()
    columns = [query_values.indices.to_numpy(zero_copy_only=False), *(ids[c] for c in ("index_name", "field", "rule_no", "group_no"))]
    levels = []
    # Queries (of an index), their fields and rules, and the word groups of those.
    for depth in (2, 4, 5):
        _, first, number = np.unique(np.stack(columns[:depth], axis=1), axis=0, return_index=True, return_inverse=True)
        levels.append((first, number.reshape(-1)))
    (query_first, query_no), (rule_first, rule_no), (group_first, group_no) = levels
    # Words are known to tasks by their place among the different numbers.
    numbers, places = np.unique(table["word_no"].to_numpy(), return_inverse=True)
    by_word = np.argsort(places.reshape(-1), kind="stable")
    value = {c: table[c].to_numpy() for c in ("boost", "n_groups", "n_fields")}
    return {
        "ids": numbers, "word_no": places.reshape(-1)[by_word], "group": group_no[by_word],
        "rule_of_group": rule_no[group_first], "query_of_rule": query_no[rule_first],
        "boost": value["boost"][rule_first].astype(float), "n_groups": value["n_groups"][rule_first], "n_fields": value["n_fields"][query_first],
        "query_id": table["query_id"].combine_chunks().take(pa.array(query_first)),
        "field": table["field"].combine_chunks().take(pa.array(rule_first)),
    }


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _per_rule(doc: np.ndarray, word: np.ndarray, weight: np.ndarray, held: dict, require_all: bool) -> tuple[np.ndarray, ...]:
    """(document, rule, weight) in order: the best variant of each word of a query, summed by field and rule."""
    start, end = np.searchsorted(held["word_no"], word), np.searchsorted(held["word_no"], word, "right")
    times = end - start
    row = np.repeat(np.arange(len(word)), times)
    slot = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + start[row]
    key = doc[row] * len(held["rule_of_group"]) + held["group"][slot]
    order = np.argsort(key)
    key, value = key[order], weight[row][order]
    first = _runs(key)
    best, key = np.maximum.reduceat(value, first) if len(first) else value, key[first]
    rule, at = held["rule_of_group"][key % len(held["rule_of_group"])], key // len(held["rule_of_group"])
    first = _runs(at * len(held["boost"]) + rule)
    total, matched = np.add.reduceat(best, first) if len(first) else best, np.diff(np.append(first, len(best)))
    at, rule = at[first], rule[first]
    if require_all:
        whole = matched >= held["n_groups"][rule]
        at, rule, total = at[whole], rule[whole], total[whole]
    return at, rule, total


def _scorer(
    held_words: Broadcast, require_all: bool, op: str, by_field: bool, most: int, carried: list[str] | None = None,
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each query of a document; with ``carried`` columns a row a document, which holds those and its queries as ``hits``."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = held_words.value
        n_words = np.diff(np.append(_runs(held["word_no"]), len(held["word_no"])))
        different = np.unique(held["word_no"])
        for batch in batches:
            lists = batch.column("words")
            word, weight = lists.flatten().to_numpy(), batch.column("weights").flatten().to_numpy()
            sizes = lists.value_lengths().to_numpy()
            doc = np.repeat(np.arange(len(sizes)), sizes)
            # Whole documents at a time, as many as give so many rows.
            rows = np.cumsum(n_words[np.searchsorted(different, word)])
            share = (rows - 1) // most
            share = np.repeat(share[np.cumsum(sizes)[sizes > 0] - 1], sizes[sizes > 0]) if len(share) else share
            for begin, end in zip(_runs(share), np.append(_runs(share)[1:], len(share)), strict=True):
                at, rule, total = _per_rule(doc[begin:end], word[begin:end], weight[begin:end], held, require_all)
                query = held["query_of_rule"][rule]
                if by_field:
                    more = {"field": held["field"].take(pa.array(rule)), "weight": pa.array(total)}
                else:
                    first = _runs(at * len(held["n_fields"]) + query)
                    score = np.add.reduceat(total * held["boost"][rule], first) if len(first) else total
                    matched = np.diff(np.append(first, len(total)))
                    at, query = at[first], query[first]
                    if op == "and":
                        whole = matched >= held["n_fields"][query]
                        at, query, score = at[whole], query[whole], score[whole]
                    more = {"weight": pa.array(score)}
                if carried is not None:
                    first = _runs(at)
                    hits = pa.StructArray.from_arrays([held["query_id"].take(pa.array(query)), more["weight"]], ["query_id", "weight"])
                    columns = {c: batch.column(c).take(pa.array(at[first])) for c in carried}
                    columns["hits"] = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), hits)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
                    continue
                columns = {
                    "query_id": held["query_id"].take(pa.array(query)),
                    **{c: batch.column(c).take(pa.array(at)) for c in ("index_name", "doc_key")}, **more,
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return score


def _best(rows: pa.Table, n: int) -> pa.Table:
    """Rows that may be among the first ``n`` of their query and index, by rounded score and then key."""
    rows = rows.combine_chunks()
    group = np.zeros(len(rows), np.int64)
    for name in ("query_id", "index_name"):
        codes = pc.rank(rows[name], tiebreaker="dense").to_numpy().astype(np.int64)
        group = group * (int(codes.max(initial=0)) + 1) + codes
    weight = rows["weight"].to_numpy()
    order = pc.sort_indices(pa.table({"group": group, "weight": -weight, "doc_key": rows["doc_key"]}),
                            sort_keys=[("group", "ascending"), ("weight", "ascending"), ("doc_key", "ascending")]).to_numpy()
    group, weight = group[order], weight[order]
    place, starts = np.arange(len(order)), _runs(group)
    sizes = np.diff(np.append(starts, len(order)))
    # The n-th score of each group that has so many rows.
    least = np.where(sizes >= n, weight[np.minimum(starts + n, starts + sizes) - 1] - APART, -np.inf)
    equal = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (weight[1:] != weight[:-1])]))
    behind = place - np.repeat(equal, np.diff(np.append(equal, len(order))))
    return rows.take(pa.array(order[(behind < n) & (weight >= np.repeat(least, sizes))]))


def _first_of(n: int, most: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Drops rows that cannot be among the first ``n`` of their query and index; what is held stays near ``most`` rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                kept = _best(pa.Table.from_batches(held), n)
                held, size = kept.to_batches(), kept.num_rows
                if size > most // 2:
                    yield from held
                    held, size = [], 0
        if held:
            yield from _best(pa.Table.from_batches(held), n).to_batches()

    return run


def _scores(
    words: DataFrame, match: Callable[[DataFrame], DataFrame], postings: DataFrame, stats: DataFrame,
    require_all: bool, op: str, by_field: bool, n: int | None = None, docs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The scores, and with ``docs`` the same rows of those documents with their columns."""
    spark = words.sparkSession
    if "rule_no" not in words.columns:
        words = words.withColumn("rule_no", F.lit(0))
    words = store(words)
    asked = numbered_words(words)
    terms = match(asked).select("word_no", "index_name", "field", "term", "df")
    numbered = words.withColumn("variant", F.lower("variant")).join(asked, [*asked_by(words), "variant"])
    if words.count() > HELD_WORDS:
        weights = posting_matches(terms, postings, stats)
        met = weights.join(numbered, ["index_name", "field", "word_no"]).repartition("query_id", "doc_key")
        rules = match_all_terms(met, require_all)
        if by_field:
            return rules.select("query_id", "index_name", "doc_key", "field", "weight"), None
        scored = match_field_operator(rules, op)
        return scored, scored.join(docs, PLACE) if docs is not None else None
    kind = words.schema["query_id"].dataType.simpleString()
    held = spark.sparkContext.broadcast(_held_words(numbered.select(
        "query_id", "index_name", "field", "rule_no", "group_no", "word_no", "boost", "n_groups", "n_fields")))
    documents = document_weights(terms, postings, stats, held)
    field = "field string, " if by_field else ""
    schema = f"query_id {kind}, index_name string, doc_key string, {field}weight double"
    score = _scorer(held, require_all, op, by_field, EXPANDED)
    if n is not None and not by_field:
        every, first = score, _first_of(max(n, 1), EXPANDED)
        score = lambda batches: first(every(batches))
    scored = documents.mapInArrow(score, schema)
    if by_field:
        return scored, None
    raw_score = F.round("weight", 6).alias("raw_score")
    rows = scored.select("query_id", "index_name", "doc_key", raw_score)
    return rows, _with_documents(documents, docs, words.schema["query_id"], held, require_all, op, raw_score) if docs is not None else None


def _with_documents(
    documents: DataFrame, docs: DataFrame, query_id: StructField, held: Broadcast, require_all: bool, op: str, raw_score: Column,
) -> DataFrame:
    """Scores of the ``docs`` with their columns, which meet a document's weights before its queries do: no row of a query moves."""
    known = documents.join(docs.hint("shuffle_hash"), PLACE)
    hit = StructType([StructField("query_id", query_id.dataType), StructField("weight", DoubleType())])
    schema = StructType([*(known.schema[c] for c in docs.columns), StructField("hits", ArrayType(hit))])
    rows = known.mapInArrow(_scorer(held, require_all, op, False, EXPANDED, docs.columns), schema).select(*docs.columns, F.inline("hits"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in PLACE]
    return rows.select(*PLACE, "query_id", raw_score, *others)


def field_scores(
    words: DataFrame, match: Callable[[DataFrame], DataFrame], postings: DataFrame, stats: DataFrame, require_all: bool = False,
) -> DataFrame:
    """(query_id, index_name, doc_key, field, weight) of every field and rule: the best variant of each word, summed.

    With ``require_all`` every word of the query must have matched in the field.
    """
    return _scores(words, match, postings, stats, require_all, "or", True)[0]


def score_bm25(
    words: DataFrame, match: Callable[[DataFrame], DataFrame], postings: DataFrame, stats: DataFrame,
    require_all: bool = False, op: str = "or", n: int | None = None,
) -> DataFrame:
    """``raw_score = Σ rule boost × Σ word max variant BM25`` per query and document.

    ``words`` holds query_id, index_name, field, group_no, variant, match_mode, boost, n_groups, n_fields and optionally
    rule_no and fuzziness; ``match`` adds the vocabulary's terms to different words. A document's word weights are gathered in one
    row, and tasks hold the queries' words; more than ``HELD_WORDS`` of them are joined instead.
    With ``n`` tasks leave out rows that ``fetch_window`` of ``n`` would not take, so all of a query's hits are never sorted.
    """
    return _scores(words, match, postings, stats, require_all, op, False, n)[0]


def score_documents(
    words: DataFrame, match: Callable[[DataFrame], DataFrame], postings: DataFrame, stats: DataFrame, docs: DataFrame,
    require_all: bool = False, op: str = "or",
) -> tuple[DataFrame, DataFrame]:
    """``score_bm25``, and its rows of the ``docs``, of which each has a row, with their columns."""
    return _scores(words, match, postings, stats, require_all, op, False, None, docs)


def fetch_window(matches: DataFrame, n: int | None = None) -> DataFrame:
    """The top ``n`` rows per query and index, before any later filter; all of them without ``n``.

    A hot query's rows are limited piece by piece first, so no task meets all of them.
    """
    if n is None:
        return matches.withColumn("fetch_rank", F.lit(None).cast("int"))
    return first_rows(matches, ["query_id", "index_name"], [F.desc("raw_score"), F.asc("doc_key")], n, "fetch_rank")
