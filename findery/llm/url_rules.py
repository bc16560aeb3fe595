"""URL filters: fixed host and path rules first, then association rules that FP-growth mines from labels.

A URL's tokens are its scheme, host labels, path segments (runs of digits count as one mark), query keys
and whether it has a fragment. Transactions are the tokens of labelled pages, with a mark on bad ones
(labelled toxic or of low quality); Spark's FP-growth finds frequent sets, and rules from tokens to the mark
are kept at a least support, confidence and lift. A rule whose tokens hold those of another rule of no less
confidence says nothing new and goes. Each rule is filed under its rarest token; a page meets only rules
filed under its own tokens, and a met rule matches when the page has all its tokens.

Whole URLs are mined. Before that, Spark counts leave out tokens that no kept rule can gain by: those rarer than the least
support and those that every labelled page has. Tokens that stand on exactly the same labelled pages (as the path parts of one
frequent long URL do, which would have 2**parts frequent sets) are mined as one, and a rule asks for any of them. A null
url, or one without "://", has empty host and path, no tokens, and is allowed. Pages are told apart by locators, so repeated
rows are each judged, and a page labelled twice is bad if one label says so; texts of any length are taken whole; of rules that
match with equal confidence any stands for the others, as only the confidence is returned. An empty table gives no rows, and no
labels give no rules; other columns are ignored; html is never read.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.common import located
from findery.session import store

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "=bad"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and what follows the path, empty where the url is null or has no '://'."""
    whole = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    tail = F.substring(after, F.length(path) + 1, F.length(after))
    return F.translate(host, UPPER, LOWER), path, tail


def tokens(url: Column, host: Column, path: Column, tail: Column) -> Column:
    def marked(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.concat(F.lit(kind), v))

    some = F.instr(F.coalesce(url, F.lit("")), "://") > 0
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    steps = F.filter(F.split(path, "/"), lambda v: v != "")
    query = F.regexp_extract(tail, r"(?s)^\?([^#]*)", 1)
    keys = F.filter(F.transform(F.split(query, "&"), lambda v: F.substring_index(v, "=", 1)), lambda v: v != "")
    found = F.concat(
        marked("s:", F.array(scheme)), marked("h:", F.filter(F.split(host, r"\."), lambda v: v != "")),
        marked("p:", F.transform(steps, lambda v: F.regexp_replace(v, "[0-9]+", "#"))), marked("q:", keys),
        F.when(F.instr(tail, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(some, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, says in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, at + start).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def informative(labelled: DataFrame, support: float) -> DataFrame:
    """(token, alike, n): a token worth mining for all that stand on the same pages of (id, tokens).

    Pages are compared by their number and two independent sums of hashes of their ids; no more tokens are alike than one URL has.
    """
    pages = labelled.count()
    least = math.ceil(support * pages - 1e-9)
    counted = labelled.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("two"))
    useful = counted.where((F.col("n") >= least) & (F.col("n") < pages))
    return useful.groupBy("n", "one", "two").agg(F.min("token").alias("token"), F.collect_set("token").alias("alike")).select("token", "alike", "n")


def mine(pages: DataFrame, labels: DataFrame, support: float, confidence: float, lift: float) -> DataFrame:
    """(tokens, needs, filed, confidence) of the rules that tell bad pages; `needs` are the tokens, any of those alike for each, and
    a rule is filed under each of those alike to its rarest token."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    placed = pages.join(marks, F.col("page_id") == F.col("id")).select(F.struct("file", "row").alias("id"), "tokens", "bad")
    labelled = store(placed)
    kinds = store(informative(labelled, support))
    kept = labelled.select("id", F.explode("tokens").alias("token")).join(kinds.select("token"), "token").groupBy("id").agg(F.collect_list("token").alias("kept"))
    none = F.array().cast("array<string>")
    items = F.concat(F.coalesce("kept", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.join(kept, "id", "left").select(items.alias("items")))
    rules = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift) & (F.col("support") >= support))
    rules = store(rules.select(F.sort_array("antecedent").alias("tokens"), "confidence"))
    # Every smaller rule that could make one needless is filed under one of its tokens.
    parts_of = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    other = rules.select(F.col("tokens").alias("less"), F.col("confidence").alias("as_sure"), F.col("tokens")[0].alias("token"))
    needless = parts_of.join(other, "token").where(
        (F.size("less") < F.size("tokens")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
    left = parts_of.join(needless.select("tokens").distinct(), "tokens", "left_anti").join(kinds, "token")
    return left.groupBy("tokens").agg(
        F.max("confidence").alias("confidence"), F.collect_list("alike").alias("needs"), F.min(F.struct("n", "token", "alike"))["alike"].alias("rarest")
    ).select("tokens", "needs", "confidence", F.explode("rarest").alias("filed"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, row, confidence) of pages that hold all tokens of a rule, with the surest rule's confidence.

    Rules are written first, so their size is known: a few are sent to the pages, whose tokens then are not shuffled.
    """
    rules = store(rules)
    met = pages.select("file", "row", "tokens", F.explode("tokens").alias("filed")).join(
        rules.select("needs", "confidence", "filed"), "filed")
    full = met.where(F.forall("needs", lambda alike: F.arrays_overlap(alike, F.col("tokens"))))
    return full.groupBy("file", "row").agg(F.max("confidence").alias("confidence"))


def url_filter(
    pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.5, lift: float = 1.5
) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page; confidence is that of the mined rule."""
    placed, file, row = located(pages)
    host, path, tail = parts(F.col("url"))
    cut = placed.select(
        F.col(file).alias("file"), F.col(row).alias("row"), F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), tail.alias("tail"),
    ).select("file", "row", "page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path"), F.col("tail")).alias("tokens"))
    found = matched(cut, mine(cut, labels, support, confidence, lift))
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    return cut.drop("tokens").join(found, ["file", "row"], "left").select(
        "page_id", "host", "path", name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
