"""Spelling corrections and completions from the names a search found.

Name hits are bounded per query by their own fetch window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The characters a name is cut at, as a character class.
NAME_SEPARATORS = "[ ,.:;\\-/\\\\()\"'\t\n\r]"
MIN_TYPED = 2


def name_words(name: Column) -> Column:
    parts = F.split(name, NAME_SEPARATORS)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _name_order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_key"), F.asc("index_name")]


def ranked_names(name_hits: DataFrame, n: int) -> DataFrame:
    """The best ``n`` names of each query, numbered."""
    order = Window.partitionBy("query_id").orderBy(*_name_order())
    return name_hits.withColumn("name_rank", F.row_number().over(order)).filter(F.col("name_rank") <= n)


def _first_by_text(rows: DataFrame, text: str, place: Column, *carried: str) -> DataFrame:
    """The first use of each text per query, ignoring case."""
    best = rows.groupBy("query_id", F.lower(text).alias("_lower")).agg(
        F.min(place).alias("place"), F.min_by(F.struct(text, *carried), place).alias("_first")
    )
    return best.select("query_id", "_first.*", "place")


def suggestion_vocabulary(name_hits: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, word, place): words of more than two characters, first casing, in rank order."""
    words = ranked_names(name_hits, n).select(
        "query_id", "name_rank", F.posexplode(name_words(F.col("name"))).alias("_pos", "word")
    ).filter(F.length("word") > 2)
    return _first_by_text(words, "word", F.struct("name_rank", "_pos"))


def spell_correct(
    queries: DataFrame, totals: DataFrame, vocabulary: DataFrame, max_edits: int = 3, threshold: int = 3
) -> DataFrame:
    """(query_id, suggestion) where some word has a nearer spelling.

    Only queries with at most ``threshold`` results are looked at. Each word takes the nearest
    vocabulary word within ``min(max_edits, max(1, length / 3))`` edits, the earlier one on ties.
    """
    few = totals.filter(F.col("total") <= threshold).select("query_id")
    asked = queries.filter(F.trim("term") != "").join(few, "query_id", "left_semi")
    words = asked.select(
        "query_id", F.posexplode(F.array_remove(F.split("term", " "), "")).alias("word_no", "typed")
    )
    allowed = F.least(F.lit(max_edits), F.greatest(F.lit(1), F.floor(F.length("typed") / 3))).cast("int")
    near = words.join(vocabulary, "query_id").withColumn("allowed", allowed)
    near = near.filter(F.abs(F.length("word") - F.length("typed")) <= F.col("allowed"))
    near = near.withColumn("edits", F.levenshtein(F.lower("typed"), F.lower("word"), max_edits))
    near = near.filter((F.col("edits") >= 0) & (F.col("edits") <= F.col("allowed")))
    best = near.groupBy("query_id", "word_no").agg(F.min_by("word", F.struct("edits", "place")).alias("best"))
    joined = words.join(best, ["query_id", "word_no"], "left")
    differs = F.coalesce(F.lower("best") != F.lower("typed"), F.lit(False))
    chosen = F.when(differs, F.col("best")).otherwise(F.col("typed"))
    lines = joined.groupBy("query_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("word_no", chosen.alias("word")))), lambda w: w["word"]
        ), " ").alias("suggestion"),
        F.bool_or(differs).alias("changed"),
    )
    return lines.filter("changed").select("query_id", "suggestion")


def _completions(queries: DataFrame, name_hits: DataFrame) -> DataFrame:
    """Name words that carry the last typed word on, offered with what was typed before it."""
    typed = F.ltrim("term")
    last = F.regexp_extract(typed, "(?s)([^ ]*)$", 1)
    asked = queries.filter(~F.coalesce(typed.rlike("(?s)[\\h\\v]$|^$"), F.lit(True))).select(
        "query_id", last.alias("prefix"),
        F.substr(typed, F.lit(1), F.length(typed) - F.length(last)).alias("before"),
    )
    words = name_hits.join(asked, "query_id").select(
        "query_id", "name_rank", "prefix", "before", F.posexplode(name_words(F.col("name"))).alias("_pos", "word")
    )
    longer = (F.length("word") > F.length("prefix")) & F.startswith(F.lower("word"), F.lower("prefix"))
    found = words.filter(longer).withColumn("text", F.concat("before", "word"))
    return _first_by_text(found, "text", F.struct("name_rank", "_pos"))


def _take(rows: DataFrame, take: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("kind", "place")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= take)


def autocomplete_words(queries: DataFrame, name_hits: DataFrame, take: int = 10) -> DataFrame:
    """(query_id, position, text): the typing completed by words of the names found."""
    names = ranked_names(name_hits, take * 3)
    rows = _completions(queries, names).withColumn("kind", F.lit(0))
    return _take(rows, take).select("query_id", "position", "text")


def suggestions(queries: DataFrame, name_hits: DataFrame, take: int = 10) -> DataFrame:
    """(query_id, position, text): completed words, then whole names not shown yet."""
    names = ranked_names(name_hits, take * 3)
    words = _completions(queries, names).select("query_id", "text", "place", F.lit(0).alias("kind"))
    whole = names.filter(F.trim("name") != "").select(
        "query_id", F.col("name").alias("text"), F.struct("name_rank", F.lit(0).alias("_pos")).alias("place"),
        F.lit(1).alias("kind"),
    )
    rows = words.unionByName(whole)
    unique = _first_by_text(rows, "text", F.struct("kind", "place")).select(
        "query_id", "text", F.col("place.kind").alias("kind"), F.col("place.place").alias("place")
    )
    return _take(unique, take).select("query_id", "position", "text")
