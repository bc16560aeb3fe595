"""The forward index: what rules read of a document, as columns.

A field map cannot be pruned: to read one flag of it, its texts are read too. Here every field that a rule names has a
column, every field that sorts its parsed key, and a scan reads those the rules of a search need. Texts are not
held; they are read for the rows of a page alone.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from findery.functions import fields as X
from findery.operators.rank import sort_column, sort_key
from findery.rules import RuleSet
from findery.session import store

ATTRIBUTES = [
    "index_name", "doc_key", "node_id", "name", "type_alias", "index_type", "index_rank", "path", "culture",
    "create_date", "update_date",
]
#: What a search joins attributes on, and what kept files are bucketed and sorted by.
PLACE = ["index_name", "doc_key"]
VARIANTS = "flag_variants"


def flag_names(rules: RuleSet) -> list[str]:
    """Flags, whose culture variants count too."""
    return sorted({n.strip().lower() for n in (X.NAVI_HIDE, *rules.hide_fields) if n.strip()})


def sort_names(rules: RuleSet) -> list[str]:
    fields = [s.field for s in rules.sort_by] + [o.field for o in rules.sort_options]
    return sorted({n.strip().lower() for n in fields if n.strip() and n.strip().lower() != "score"})


def rule_names(rules: RuleSet) -> list[str]:
    """Stored fields that filters, boosts, facets and de-duplication read, with the sort twins some of them prefer."""
    names = [X.PUBLISHED, X.UPDATE_DATE, X.CREATE_DATE, *flag_names(rules), rules.dedup_field]
    names += [rules.recency.field] if rules.recency else []
    names += [f.target for f in rules.facets]
    plain = sorted({n.strip().lower() for n in names if n and n.strip()})
    return plain + [X.SORT_PREFIX + n for n in plain]


def _held(name: str) -> str:
    return f"field:{name}"


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ForwardIndex:
    """``rows``: a row a document, its keys and columns ``field:<name>``, ``sort:<name>`` and the variants of flags."""

    rows: DataFrame

    def covers(self, rules: RuleSet) -> bool:
        held = set(self.rows.columns)
        return all(_held(n) in held for n in rule_names(rules)) and all(sort_column(n) in held for n in sort_names(rules))

    def attributes(self, rules: RuleSet) -> DataFrame:
        """What the rules need of each document: keys, parsed sort keys, and the other fields as a small map."""
        pairs = [x for n in rule_names(rules) for x in (F.lit(n), _col(_held(n)))]
        fields = F.map_filter(F.map_concat(F.create_map(*pairs), F.col(VARIANTS)), lambda _, v: v.isNotNull())
        return self.rows.select(*ATTRIBUTES, fields.alias("fields"), *[_col(sort_column(n)) for n in sort_names(rules)])

    def stored(self) -> ForwardIndex:
        return ForwardIndex(store(self.rows))

    def write(self, path: str, buckets: int | None = None) -> None:
        """Kept in buckets by document, so that a search moves its matches and not these rows. There are as many buckets as
        the session has shuffle partitions, which are set for the data, unless told otherwise."""
        spark = self.rows.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"forward_{uuid.uuid4().hex}"
        placed = self.rows.repartition(buckets, *PLACE).sortWithinPartitions(*PLACE)
        placed.write.bucketBy(buckets, *PLACE).sortBy(*PLACE).mode("overwrite").option("path", f"{path}/forward").saveAsTable(name)
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/forward_layout")
        spark.sql(f"DROP TABLE {name}")


def build_forward(docs: DataFrame, rules: RuleSet) -> ForwardIndex:
    """One pass over the documents, without a shuffle."""
    flags = flag_names(rules)

    def variant(key: Column, _: Column) -> Column:
        found = F.lit(False)
        for flag in flags:
            found = found | key.startswith(flag + "_")
        return found

    return ForwardIndex(docs.select(
        *ATTRIBUTES, *[X.stored(n).alias(_held(n)) for n in rule_names(rules)],
        *[sort_key(n).alias(sort_column(n)) for n in sort_names(rules)], F.map_filter("fields", variant).alias(VARIANTS),
    ))


def read_forward(spark: SparkSession, path: str) -> ForwardIndex | None:
    """A kept forward index with its buckets; None where none was written."""
    try:
        buckets = spark.read.parquet(f"{path}/forward_layout").first().buckets
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    name = f"forward_{uuid.uuid4().hex}"
    columns = spark.read.parquet(f"{path}/forward").schema.toDDL()
    place = ", ".join(PLACE)
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({place}) SORTED BY ({place}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}/forward'"
    )
    return ForwardIndex(spark.table(name))
