"""The table of registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from findery.session import configure
from findery.workload.sqlviews import sql

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def register(name: str, statement: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if statement is not None:
            SQL[name] = sql(statement)
        return build

    return add
