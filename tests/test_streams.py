"""Streams over several batches."""

import time

import pytest
from pyspark.sql import functions as F

from findery.session import settings
from findery.streaming import budget as B

SCHEMA = "event_id int, stage string, caller string, us bigint"


def feed(spark, folder, rows):
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    frame.write.mode("append").parquet(folder)


def run(spark, folder, base, keep=None):
    src = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("ts", F.timestamp_micros("us"))
    out = f"{base}/out"

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with settings(spark, {**B.STATE, "spark.sql.shuffle.partitions": "2"}):
        query = B.stream_admit_budget(src, 2, 10, keep).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state")
        query.trigger(availableNow=True).start().awaitTermination()
    return {r.event_id: r.is_admitted for r in spark.read.parquet(out).collect()}


def test_windows_go_on_in_the_next_batch(spark, tmp_path):
    base, folder = str(tmp_path), str(tmp_path / "in")
    second = 1_000_000
    feed(spark, folder, [(1, "s", "a", 0), (2, "s", "a", 5 * second), (3, "s", "b", 0), (4, "s", None, 0), (9, "s", "a", None)])
    assert run(spark, folder, base) == {1: True, 2: True, 3: True, 4: True, 9: False}
    # a has used its window up; b has one left; the fourth event of a opens a new window.
    feed(spark, folder, [(5, "s", "a", 9 * second), (6, "s", "b", 9 * second), (7, "s", "a", 10 * second), (8, "s", "b", 9 * second)])
    got = run(spark, folder, base)
    assert {k: got[k] for k in (5, 6, 7, 8)} == {5: False, 6: True, 7: True, 8: False}


def test_state_of_a_caller_ends(spark, tmp_path):
    base, folder = str(tmp_path), str(tmp_path / "in")
    feed(spark, folder, [(i, "s", f"c{i}", 0) for i in range(20)])
    run(spark, folder, base, keep=1)
    time.sleep(2)
    feed(spark, folder, [(100, "s", "late", 0)])
    run(spark, folder, base, keep=1)
    with settings(spark, {**B.STATE, "spark.sql.shuffle.partitions": "2"}):
        state = spark.read.format("statestore").option("path", f"{base}/state").option("stateVarName", "window").load()
        assert {r.caller for r in state.select("key.caller").collect()} == {"late"}


def test_a_frame_is_walked_window_by_window(spark, tmp_path):
    base, folder = str(tmp_path), str(tmp_path / "in")
    feed(spark, folder, [(i, "s", "a", i * 1_000_000) for i in range(50)])
    admitted = run(spark, folder, base)
    assert {k for k, v in admitted.items() if v} == {w * 10 + k for w in range(5) for k in range(2)}


DOC = ("doc_key string, node_id bigint, name string, type_alias string, index_type string, index_name string, index_rank int, path array<bigint>, "
       "culture string, create_date string, update_date string, fields map<string,string>, version int, is_deleted boolean")


def changes(spark, folder, rows):
    full = [(k, i, name, "t", "content", "main", 0, [-1], None, None, None, {"body": body} if body else {}, v, gone)
            for i, (k, name, body, v, gone) in enumerate(rows)]
    spark.createDataFrame(full, DOC).coalesce(1).write.mode("append").parquet(folder)


def test_streamed_index_equals_a_fresh_one(spark, tmp_path):
    from findery.operators.postings import build_postings, read_index
    from findery.streaming import index as SI

    folder, path, state = (str(tmp_path / n) for n in ("in", "index", "state"))
    batches = [
        [("a", "one", "red red blue", 1, False), ("b", "two", "red", 1, False), ("c", "three", "", 1, False)],
        [("a", "one", "green", 2, False), ("a", "one", "old text", 1, False), ("b", "two", None, 2, True), ("d", "four", "red", 1, False)],
        [("b", "two again", "blue", 3, False), ("d", "four", None, 2, True), ("x", "never", None, 1, True)],
    ]
    left = {}
    for number, rows in enumerate(batches):
        changes(spark, folder, rows)
        src = spark.readStream.schema(DOC).parquet(folder)
        SI.stream_index(src, path, state, ["nodename", "body"], variants=False, available_now=True).awaitTermination()
        for key in {r[0] for r in rows}:
            left[key] = max((r for r in rows if r[0] == key), key=lambda r: r[3])
    changes(spark, str(tmp_path / "final"), [r for r in left.values() if not r[4]])
    fresh = build_postings(spark.read.parquet(str(tmp_path / "final")), ["nodename", "body"], False)

    def shown(index):
        return (
            sorted(map(tuple, index.postings.select("field", "term", "doc_key", "tf", "doc_len").collect())),
            sorted(map(tuple, index.vocab.select("field", "term", "df").collect())),
            sorted(map(tuple, index.stats.select("field", "n_docs", "avg_len").collect())),
        )

    assert shown(SI.read_streamed_index(spark, path)) == shown(fresh)
    # The last batch once more, as after a failure between its writes and its commit.
    again = spark.read.schema(DOC).parquet(folder).filter("doc_key in ('b', 'd', 'x') and version >= 2 and not (doc_key = 'b' and version = 2)")
    SI.apply_changes(again, path, 2, ["nodename", "body"], False)
    assert shown(SI.read_streamed_index(spark, path)) == shown(fresh)
    SI.compact(spark, path, str(tmp_path / "kept"))
    assert shown(read_index(spark, str(tmp_path / "kept"))) == shown(fresh)


def test_purge_drops_days_and_rewrites_the_border(spark, tmp_path):
    import os

    from findery.sources import logs as L

    def table(name, rows, columns):
        frame = spark.createDataFrame(rows, columns).withColumn("create_date", F.col("create_date").cast("timestamp_ntz"))
        L.dated(frame).write.partitionBy("log_date").parquet(f"{tmp_path}/{name}")

    searches = [(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-02 20:00:00"), (4, "2024-01-03 01:00:00"), (5, None)]
    clicks = [(1, "x", "2024-01-01 10:01:00"), (2, "x", "2024-01-03 00:00:00"), (3, "x", "2024-01-03 00:00:00"), (99, "x", "2024-01-01 12:00:00"), (2, "y", "2024-01-02 11:00:00")]
    table("s", searches, "query_key int, create_date string")
    table("c", clicks, "query_key int, node_key string, create_date string")
    paths = f"{tmp_path}/s", f"{tmp_path}/c"
    before = set(os.listdir(f"{tmp_path}/s/log_date=2024-01-03"))
    assert L.purge_log_tables(spark, *paths, 0, as_of="2024-01-12 12:00:00").searches == 0
    done = L.purge_log_tables(spark, *paths, 10, as_of="2024-01-12 12:00:00")
    assert (done.searches, done.clicks, done.dropped_days) == (2, 3, ("2024-01-01",))
    assert sorted(d for d in os.listdir(f"{tmp_path}/s") if d.startswith("log")) == ["log_date=2024-01-02", "log_date=2024-01-03", "log_date=__HIVE_DEFAULT_PARTITION__"]
    assert sorted(d for d in os.listdir(f"{tmp_path}/c") if d.startswith("log")) == ["log_date=2024-01-01", "log_date=2024-01-03"]
    assert set(os.listdir(f"{tmp_path}/s/log_date=2024-01-03")) == before
    assert {r.query_key for r in spark.read.parquet(paths[0]).collect()} == {3, 4, 5}
    assert sorted(r.query_key for r in spark.read.parquet(paths[1]).collect()) == [3, 99]
    again = L.purge_log_tables(spark, *paths, 10, as_of="2024-01-12 12:00:00")
    assert (again.searches, again.clicks, again.dropped_days) == (0, 0, ())


def test_a_batch_of_changes_shuffles_documents_once_and_only_their_indexed_fields(spark, tmp_path, monkeypatch):
    from findery.streaming import index as SI

    fields = "map('body', 'one two', 'body_en', 'one three', 'bodies', 'x', 'other', 'long') AS fields"
    changes = spark.range(20).selectExpr(
        "'main' AS index_name", "'content' AS index_type", "'page' AS type_alias", "cast(id % 10 AS string) AS doc_key", "'n' AS name",
        fields, "cast(id AS int) AS version", "false AS is_deleted")
    kept = []
    monkeypatch.setattr(SI, "store", lambda frame: kept.append(frame) or frame)
    SI.apply_changes(changes, str(tmp_path), 0, ["Body"], True)
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = kept[0].collect()
    assert sorted(r.version for r in rows) == list(range(10, 20)) and all(set(r.fields) == {"body", "body_en"} for r in rows)
    assert set(SI.only_named(changes, ["Body"], False).first().fields) == {"body"}
    terms = SI.read_streamed_index(spark, str(tmp_path)).vocab.collect()
    assert {(r.field, r.term): r.df for r in terms} == {("body", "one"): 10, ("body", "two"): 10, ("body_en", "one"): 10, ("body_en", "three"): 10}
