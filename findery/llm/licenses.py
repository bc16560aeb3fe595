"""License scans: an exact set-similarity join of text blocks with license notices, in DataFrame functions only.

Words are runs of a-z, 0-9 and anything beyond ASCII, after lower-casing. A document is cut into blocks of
`width` words, a new one every half width, so any run of half a width lies whole in some block; the width
is twice the longest notice. A block matches a notice when it holds at least `threshold` of the notice's
distinct words. The join finds every such pair:

- words of notices are ordered by how many documents of the whole corpus hold them, rarest first;
- a notice of t words that must share k of them is indexed under its first t - k + 1 words (prefix filter);
- blocks with fewer than k of the notices' words cannot match (length filter);
- a shared word at place i of the notice and j of the block leaves at most 1 + the smaller rest (positional
  filter);
- pairs that are left are counted exactly.

The notices' words are literals of the plan: their number is the caller's, not the data's. Blocks meet
the index before anything is shuffled; only matches, one row a document, are. A null text is an empty one
and has no words; rows of any doc_id, null or repeated, are told apart by their locators; long texts are scanned whole; of blocks that
match equally well any gives the score, and equal labels count once; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import located

#: Phrases that count wherever their words stand one after another, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices by label.
NOTICES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SPLIT), "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(SPLIT, text.lower()) if w]


def places(words: Column, phrase: str) -> Column:
    """Starts of a phrase among the words."""
    first, *rest = phrase.split()

    def here(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            found = found & (F.get(words, i + k) == word)
        return F.coalesce(found, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def base(placed: DataFrame, file: str, row: str) -> DataFrame:
    """(file, row, doc_id, n_words, n_base, first_word, last_word, base) of every row."""
    nowhere = F.array().cast("array<int>")
    rows = placed.select(
        F.col(file).alias("file"), F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"),
    )
    last = {phrase.split()[-1] for phrase, _ in PHRASES}
    some = F.arrays_overlap("words", strings(sorted(last)))
    found = rows.select(
        "file", "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        *[F.when(some, places(F.col("words"), phrase)).otherwise(nowhere).alias(f"at_{i}") for i, (phrase, _) in enumerate(PHRASES)],
    )
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at_{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    return found.select(
        "file", "row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_distinct(labels).alias("base"),
    )


def corpus_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The notices' words, those of the fewest documents first: a row a word comes to the driver."""
    seen = words.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("word"))
    counts = {r.word: r.n for r in seen.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(placed: DataFrame, file: str, row: str, notices, threshold: float) -> DataFrame:
    """(file, row, label, containment) of each block and notice that match."""
    spark = placed.sparkSession
    wanted = [(label, sorted(set(plain_words(text)))) for label, text in notices]
    step = max((len(plain_words(text)) for _, text in notices), default=1)
    rows = placed.select(
        F.col(file).alias("file"), F.col(row).alias("row"),
        words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"),
    )
    order = corpus_order(rows, sorted({w for _, words in wanted for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, words in wanted:
        ranked, least = sorted(words, key=rank.__getitem__), ceil(threshold * len(words) - 1e-9)
        index += [(word, label, i, len(ranked), least, ranked) for i, word in enumerate(ranked[: len(ranked) - least + 1])]
    fewest = min((k for *_, k, _ in index), default=1)
    entries = F.array(*[
        F.struct(
            F.lit(word).alias("word"), F.lit(label).alias("label"), F.lit(i).alias("i"), F.lit(t).alias("t"),
            F.lit(k).alias("k"), strings(ranked).alias("notice"),
        )
        for word, label, i, t, k, ranked in index
    ])
    index_rows = spark.range(1).select(F.inline(entries))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - step - 1, F.lit(0)), F.lit(step))
    cut = F.transform(starts, lambda s: F.array_intersect(strings(order), F.slice("words", s + 1, 2 * step)))
    blocks = (
        rows.select("file", "row", F.explode(F.filter(cut, lambda held: F.size(held) >= fewest)).alias("held"))
        .select("file", "row", "held", F.posexplode("held").alias("j", "word"))
    )
    room = 1 + F.least(F.col("t") - F.col("i") - 1, F.size("held") - F.col("j") - 1)
    pairs = blocks.join(index_rows, "word").where((F.size("held") >= F.col("k")) & (room >= F.col("k")))
    shared = pairs.select("file", "row", "label", "t", "k", F.size(F.array_intersect("held", "notice")).alias("shared"))
    return shared.where("shared >= k").select("file", "row", "label", (F.col("shared") / F.col("t")).alias("containment"))


def license_scan(docs: DataFrame, notices=NOTICES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is 1 where a phrase stands, else the best containment of a matching notice, else 0.
    """
    placed, file, row = located(docs)
    found = matches(placed, file, row, notices, threshold).groupBy("file", "row").agg(
        F.max("containment").alias("best"), F.collect_set("label").alias("more"))
    labels = F.sort_array(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return base(placed, file, row).join(found, ["file", "row"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
