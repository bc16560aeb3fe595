"""Registered queries: streams run to the end of what is there, beside their batch results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from findery.session import settings, shared_folder
from findery.sources.logs import LogSettings
from findery.streaming import budget as B, content as C, index as SI, logs as L
from findery.workload import tables as T
from findery.workload.extract_queries import clean, words
from findery.workload.registry import register


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = T.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _finish(spark: SparkSession, start: Callable[[], object]) -> None:
    """Runs a stream until it has read everything, with as many state partitions as cores."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        query = start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        spark.conf.set(name, before)


def _drain(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """All rows a stream gives; with ``keys``, the latest row of each."""
    out, checkpoint = _folders(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    _finish(spark, lambda: writer.trigger(availableNow=True).start())
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_id", LongType())])).parquet(out)
    if keys is None:
        return rows.drop("batch_id")
    values = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return latest.select(*keys, "v.*")


_LOGGED = """SELECT query_key, term, lower(regexp_replace(term, '\\s+', ' ', 'g')) AS normalized_term, result_count, culture FROM (
  SELECT * REPLACE (trim(term) AS term) FROM raw_searches) WHERE profile_alias <> 'ad-hoc' AND length(term) >= 2"""


@register("stream_search_log", _LOGGED)
def stream_search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = _folders(spark)
    src = T.raw_search_rows(_stream(spark, sf_dir, "events"))
    _finish(spark, lambda: L.stream_search_log(src, out, checkpoint, LogSettings(), available_now=True))
    return spark.read.parquet(out).select("query_key", "term", "normalized_term", "result_count", "culture")


_ZERO = "CAST(sum(CASE WHEN result_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_results"


@register(
    "stream_daily_volume",
    f"SELECT strftime(create_date, '%Y-%m-%d') AS day, count(*) AS searches, {_ZERO} FROM search_log GROUP BY 1",
)
def stream_daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = T.search_rows(_stream(spark, sf_dir, "events"))
    rows = _drain(spark, L.stream_daily_volume(src), "update", ["day"])
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "stream_term_counts",
    f"SELECT strftime(create_date, '%Y-%m-%d') AS day, term, count(*) AS searches, {_ZERO} FROM search_log GROUP BY 1, 2",
)
def stream_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = T.search_rows(_stream(spark, sf_dir, "events"))
    rows = _drain(spark, L.stream_term_counts(src), "update", ["day", "term"])
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register(
    "stream_click_attribution",
    """WITH s AS (SELECT query_key, term, create_date FROM search_log), c AS (SELECT * FROM click_log),
      j AS (SELECT s.query_key, s.term, c.node_key, c.position FROM s JOIN c ON c.query_key = s.query_key
        AND c.create_date >= s.create_date AND c.create_date <= s.create_date + INTERVAL 1 HOUR),
      mark AS (SELECT least((SELECT max(create_date) FROM s), (SELECT max(create_date) FROM c)) - INTERVAL 10 MINUTE AS w)
    SELECT * FROM j UNION ALL
    SELECT query_key, term, NULL, NULL FROM s, mark WHERE query_key NOT IN (SELECT query_key FROM j)
      AND create_date + INTERVAL 1 HOUR < w""",
)
def stream_click_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclicked searches of the last stretch still wait when the stream ends."""
    searches = T.search_rows(_stream(spark, sf_dir, "events"))
    clicks = T.click_rows(_stream(spark, sf_dir, "events"))
    rows = _drain(spark, L.stream_click_attribution(searches, clicks), "append")
    return rows.select("query_key", "term", "node_key", "position")


@register(
    "stream_extract_content",
    f"""SELECT doc_key, CASE WHEN {words('t')} >= 6 THEN t END AS text
    FROM (SELECT doc_key, {clean('f_bodytext')} AS t, unnest([1, 2]) AS pass, {words("f_bodytext")} >= 6 AS long FROM docs_text) WHERE pass = 1 OR long""",
)
def stream_extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariant and the culture text of each document; one row where there is none."""
    labels = T.table(spark, sf_dir, "labels")
    docs = T.text_docs(_stream(spark, sf_dir, "documents").join(labels, "doc_id", "left"), "main", 0)
    out, checkpoint = _folders(spark)
    _finish(spark, lambda: C.stream_extract_content(docs, out, checkpoint, structured=False, available_now=True))
    return spark.read.parquet(out).select("doc_key", "text")


@register(
    "stream_admit_budget",
    """WITH RECURSIVE e AS (SELECT event_id, user_id AS caller, epoch_us(ts) AS us FROM events),
    opens AS (
      SELECT caller, min(us) AS us FROM e GROUP BY caller
      UNION ALL
      SELECT o.caller, min(e.us) FROM opens o JOIN e ON e.caller = o.caller AND e.us >= o.us + 86400000000 GROUP BY o.caller
    ),
    placed AS (SELECT e.event_id, e.caller, e.us, max(o.us) AS opened FROM e JOIN opens o ON o.caller = e.caller AND o.us <= e.us
      GROUP BY ALL)
    SELECT event_id, caller, row_number() OVER (PARTITION BY caller, opened ORDER BY us, event_id) <= 2 AS is_admitted FROM placed""",
)
def stream_admit_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = T.budget_rows(_stream(spark, sf_dir, "events"))
    with settings(spark, B.STATE):
        rows = _drain(spark, B.stream_admit_budget(src, 2, 86400), "append")
    return rows.select("event_id", "caller", "is_admitted")


@register(
    "stream_index",
    r"""WITH d AS (SELECT doc_key, CASE WHEN CAST(doc_key AS BIGINT) % 3 = 0 THEN name ELSE f_bodytext END AS body FROM docs_text
      WHERE CAST(doc_key AS BIGINT) % 5 <> 0),
    t AS (SELECT doc_key, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS toks FROM d WHERE body IS NOT NULL),
    p AS (SELECT doc_key, term, doc_len, count(*) AS tf FROM (SELECT doc_key, unnest(toks) AS term, len(toks) AS doc_len FROM t) GROUP BY ALL)
    SELECT doc_key, p.term, doc_len, tf, df FROM p JOIN (SELECT term, count(*) AS df FROM p GROUP BY ALL) v ON v.term = p.term""",
)
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive; then every third changes its text and every fifth goes."""
    base, checkpoint = _folders(spark)
    docs, key = T.docs_text(spark, sf_dir), F.col("doc_key").cast("bigint")
    first = docs.withColumns({"version": F.lit(1), "is_deleted": F.lit(False)})
    text = F.map_concat(F.map_filter("fields", lambda k, _: k != "bodytext"), F.create_map(F.lit("bodytext"), F.col("name")))
    second = docs.filter((key % 3 == 0) | (key % 5 == 0)).withColumns({"fields": text, "version": F.lit(2), "is_deleted": key % 5 == 0})
    for changes in (first, second):
        changes.write.mode("append").parquet(f"{base}/changes")
        src = spark.readStream.schema(first.schema).parquet(f"{base}/changes")
        _finish(spark, lambda: SI.stream_index(src, f"{base}/index", checkpoint, ["bodytext"], variants=False, available_now=True))
    index = SI.read_streamed_index(spark, f"{base}/index")
    return index.postings.join(index.vocab, ["index_name", "field", "term"]).select("doc_key", "term", "doc_len", "tf", "df")
