"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data (default /root/testdata/sf0.1), BENCH_CPUS the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from findery.plans.search import index_for, search
from findery.session import configure
from findery.workload import all_queries, search_queries, tables

HEADLINE = (
    "search_batch", "match_fuzzy", "facet_counts_excluding_self", "facet_date_range", "extracted_content",
    "term_report", "log_summary", "build_postings", "apply_facet_filters", "sort_multi", "dedup_by_field",
    "autocomplete", "admit_within_budget",
)


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(work) -> float:
    began = time.perf_counter()
    work()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = configure(
        SparkSession.builder.master(f"local[{cores}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cores)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One small query first, so that starting the session is not counted as work.
    run(queries["daily_volume"](spark, sf_dir))
    times = {name: timed(lambda n=name: run(queries[n](spark, sf_dir))) for name in HEADLINE}
    # The same search against a kept index, as a site runs it.
    docs, rules = tables.docs_text(spark, sf_dir), search_queries.RULES
    index = index_for(docs, rules)
    times["search_kept_index"] = timed(lambda: run(search(tables.q_text(spark, sf_dir), docs, rules, index=index).page))
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
