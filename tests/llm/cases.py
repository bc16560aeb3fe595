"""Awkward documents that every operator has to take."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest int, kept string, start int"

ROWS = [
    (5, "One two three four five six seven eight nine ten.", "en", "a", 1, 1, "x", 2),
    (5, "One two three four five six seven eight nine ten.", "en", "a", 1, 1, "x", 2),
    (7, None, None, None, None, None, None, None),
    (None, "a null id", "en", "b", 0, 0, "y", 1),
    (8, "", "en", "a", 0, 0, "", 0),
    (9, " \n\t  ", "en", "a", 5, 0, "", 0),
    (10, "One  two three\nfour five six seven eight nine ten.", "en", "a", 1, 1, "x", 2),
    (11, "ééé ÀÉ 🙂 ▁ ​ \x1c \x85 Don't 'S 12.5   x\r\n\r\n y ", "fr", "a", 1, 1, "x", 2),
    (12, "long " * 30_000 + "x" * 20_000, "en", "a", 1, 1, "x", 2),
    (-3, "<|endoftext|> MIT License", "en", "a", 1, 1, "x", 2),
]


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
