"""Runs registered queries beside their SQL twins and compares the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("findery")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, (int, float)):
        return repr(round(float(value), 6) + 0.0)
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(canonical(row[i]) for i in order) for row in rows
    )


def compare(spark, con, sf_dir: str, build, statement: str | None) -> tuple[bool, str]:
    began = time.time()
    frame = build(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    took = time.time() - began
    if statement is None:
        return True, f"{len(got[1])} rows, no SQL, {took:.1f}s"
    began = time.time()
    cursor = con.execute(statement)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    note = f"{len(got[1])} rows, {took:.1f}s, SQL {time.time() - began:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        missing = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"{len(got[1])} vs {len(want[1])} rows\n   {got[0]}\n   spark {extra}\n   sql   {missing}"
    return True, note


def main() -> None:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    statements, bad = entry.oracle_sql(), []
    for name, build in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, build, statements.get(name))
        except Exception as error:  # keep going: one report for all keys
            ok, note = False, f"{type(error).__name__}: {str(error)[:1200]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)


if __name__ == "__main__":
    main()
