"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams, rarest first, start with a prefix of three: one edit destroys at most two of its bigrams. Of the
prefix, dynamic programming chooses the two that do not overlap and are rarest together: its pivots. One edit
cannot touch both, so of two near words the one whose prefix ends earlier in the global order has a pivot among the other's
prefix. Pivots are therefore joined with prefixes on the gram and on where it may stand: at the same place in a word
of the same length, and at most one place along in one a letter longer or shorter. The edit lies on one side of a pivot that
survives, so everything on its other side has to be equal, and is part of the join's key. The edit distance is verified
inside that join, so candidates are never written out.

Bigrams are counted over the whole vocabulary; their table is bounded by the alphabet (90 letters: 8,100 pairs). Words are
counted before they are shuffled. A gram that many words share is split by adaptive execution. Tables of words meet by shuffles and are
never broadcast, as Spark takes them for as large as their files, without the rows that grams add. The links of a
word to the root of its forms double in length each round, and a form is at least twice as frequent as its
word, so rounds are few.

A null text has no words; a null doc_id counts as an empty string where runs are changed; repeated rows count again; other
columns are ignored; runs may be of any length; ties between forms go to the smallest in code-point order; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.session import store

LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Length of a gram, and of the prefix that leaves one gram of two near words whole.
GRAM, PREFIX, PIVOTS = 2, 3, 2
KEYED = "word string, length int, last long, prefix array<struct<gram:int,pos:int>>, pivots array<struct<gram:int,pos:int>>"


def changed_run(doc_id: Column, run: Column, every: int) -> Column:
    """The run, or in one of `every` cases the run without one code point; the checksum of id and run decides."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(mark, F.char_length(run)).cast("int")
    without = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(F.pmod(mark, F.lit(every)) == 0, without).otherwise(run)


def vocabulary(docs: DataFrame, every: int, letters: int, least: int) -> DataFrame:
    """(word, n) of the changed runs that are long and frequent enough."""
    runs = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(runs).alias("run")).select(
        changed_run(F.col("doc_id"), F.col("run"), every).alias("word"))
    return words.where(F.char_length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def disjoint(places: list[tuple[int, int]], count: int, size: int = GRAM) -> list[int]:
    """Indices of `count` of the (position, cost), by ascending position, that do not overlap and cost least together.

    best[j] holds, for the items so far, the cheapest choice of j of them.
    """
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * count]
    for i, (position, cost) in enumerate(places):
        before = sum(p + size <= position for p, _ in places[:i])
        row = list(best[-1])
        for j in range(1, count + 1):
            head = best[before][j - 1]
            if head is not None and (row[j] is None or head[0] + cost < row[j][0]):
                row[j] = (head[0] + cost, (*head[1], i))
        best.append(row)
    chosen = best[-1][count]
    return list(chosen[1]) if chosen else []


def keyed(vocab: DataFrame) -> DataFrame:
    """Each word's prefix and pivots by gram rank and position, and where its prefix ends in the global order."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substr("word", i, F.lit(GRAM)))
    counted = vocab.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    # At most 8,100 rows, as words have no other letters than LETTERS.
    table = sorted((r.n, r.gram) for r in counted.collect())
    ranks = {gram: (rank, n) for rank, (n, gram) in enumerate(table)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("gram", pa.int32()), ("pos", pa.int32())]))
        for batch in batches:
            words = batch.column("word").to_pylist()
            lasts, prefixes, pivots = [], [], []
            for word in words:
                every = sorted((ranks[word[p : p + GRAM]][0], p) for p in range(len(word) - GRAM + 1))
                order = every[:PREFIX]
                placed = sorted(order, key=lambda g: g[1])
                chosen = disjoint([(p, table[rank][0]) for rank, p in placed], PIVOTS)
                last, end = order[-1]
                lasts.append(last << 40 | end)
                # In a run of one letter the last gram stands once more a place along, where a moved pivot may have to find it.
                again = [(last, end + 1)] if (last, end + 1) in every[PREFIX : PREFIX + 1] else []
                prefixes.append([{"gram": rank, "pos": p} for rank, p in order + again])
                pivots.append([{"gram": placed[i][0], "pos": placed[i][1]} for i in chosen])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"), pa.array([len(w) for w in words], pa.int32()), pa.array(lasts, pa.int64()),
                    pa.array(prefixes, kind), pa.array(pivots, kind),
                ],
                ["word", "length", "last", "prefix", "pivots"],
            )

    return vocab.select("word").mapInArrow(run, KEYED)


def shuffled(words: DataFrame) -> DataFrame:
    """Joined by shuffles: a compressed file, and an explode above it, say little of the rows a broadcast would gather."""
    return words.hint("merge")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(a, b), a before b, of all words exactly one edit apart. Words need PREFIX + 1 letters at least."""
    marked = store(keyed(vocab))

    def key(word: str, side: Column, at: Column, pos: Column, length: Column) -> Column:
        """Gram (within the text on its side), place, length and side as one number; words themselves are verified."""
        text = F.when(side == "left", F.substr(word, F.lit(1), at + GRAM)).otherwise(F.substr(word, at + 1))
        return F.xxhash64("gram", pos, length, side, text).alias("key")

    sides = F.array(F.lit("left"), F.lit("right"))
    prefixes = marked.select("word", "last", "length", F.inline("prefix")).select("*", F.explode(sides).alias("side")).select(
        F.col("word").alias("other"), F.col("last").alias("other_last"), key("word", F.col("side"), F.col("pos"), F.col("pos"), F.col("length")))
    # Where the other word may hold a pivot: (how much longer it is, how far the pivot moves, which side is unchanged).
    cases = ((0, 0, "left"), (0, 0, "right"), (1, 0, "left"), (1, 1, "right"), (-1, 0, "left"), (-1, -1, "right"))
    moves = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(m).alias("moved"), F.lit(s).alias("side")) for d, m, s in cases])
    pivots = marked.select("word", "last", "length", F.inline("pivots")).select("*", F.inline(moves)).select(
        "word", "last", key("word", F.col("side"), F.col("pos"), F.col("pos") + F.col("moved"), F.col("length") + F.col("longer")))
    verified = (F.col("last") <= F.col("other_last")) & (F.levenshtein("word", "other", 1) == 1)
    met = shuffled(pivots).alias("l").join(shuffled(prefixes).alias("r"), (F.col("l.key") == F.col("r.key")) & verified)
    return met.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: links are doubled until none grows."""
    links = store(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = store(shuffled(links).join(shuffled(onward), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("grew")))
        links = longer.select("word", "root")
        if longer.where("grew").isEmpty():
            return links


def spelling_forms(docs: DataFrame, every: int = 97, letters: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    if letters < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} letters, so that two of their first grams never overlap")
    vocab = store(vocabulary(docs, every, letters, least))
    pairs = store(near_pairs(vocab))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    others = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    known = shuffled(both).join(shuffled(others), "other")
    best = known.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    chosen = F.col("best.less") * -1 >= F.col("n") * times
    forms = store(shuffled(vocab).join(shuffled(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    return shuffled(forms).join(shuffled(roots(forms)), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
