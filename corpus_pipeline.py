"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

A null text is an empty one in every stage: it is not toxic, is a copy of other empty texts, has no near duplicates, holds no benchmark
item and gives no tokens. Rows with null or repeated doc_ids are told apart by where they stand; of equal texts the longest
original stays, of near ones and of ties the smallest doc_id (null last), then the first row. Texts of any length are taken whole; columns
beyond those of documents are carried to the last stage, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from findery.llm import byte_bpe, decontaminate, exact_dedup, near_dups, toxicity
from findery.llm.common import configure, table
from findery.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    configure(spark)
    return exact_dedup.distinct_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    configure(spark)
    return near_dups.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    configure(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_decode(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: A trained model decides which documents stay, so no SQL gives the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
