"""The registered query of each operator: production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from findery.llm import (
    byte_bpe, decontaminate, exact_dedup, licenses, maxent, near_dups, repeats, spelling, token_counts, token_files, toxicity,
    url_rules, vector_codes,
)
from findery.llm.common import table
from findery.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.digests(token_files.read_tokens(spark, path))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op6_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.language_scores(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.drop("ids")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(table(spark, sf_dir, "documents"))[0]
    return found.drop("file", "row")


@query
def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


@query
def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


SQL["op3_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
), ranked AS (
  SELECT doc_id, plain, first_value(doc_id) OVER best AS keep_id, row_number() OVER best = 1 AS kept,
    count(*) OVER (PARTITION BY plain) AS group_size
  FROM texts WINDOW best AS (PARTITION BY plain ORDER BY length(whole) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, sha256(plain) AS text_sha256 FROM ranked
"""


def _license_sql() -> str:
    """All blocks against all notices, without any filter."""
    wanted = [(label, licenses.plain_words(text)) for label, text in licenses.NOTICES]
    step = max(len(words) for _, words in wanted)
    notices = ", ".join(f"('{label}', {sorted(set(words))!r})" for label, words in wanted)
    starts = " UNION ALL ".join(
        f"SELECT id, unnest(list_filter(range(len(words)), lambda i: array_to_string(words[i + 1 : i + {len(p.split())}], ' ') = '{p}')) AS spot,"
        f" '{label}' AS label FROM cut" for p, label in licenses.PHRASES
    )
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), starts AS ({starts}
), base AS (
  SELECT id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM starts GROUP BY id
), blocks AS (
  SELECT id, words[s + 1 : s + {2 * step}] AS held
  FROM (SELECT id, words, unnest(range(0, greatest(len(words) - {step}, 1), {step})) AS s FROM cut)
), met AS (
  SELECT id, label, len(list_intersect(notice, held)) / len(notice) AS containment
  FROM blocks, (VALUES {notices}) AS n(label, notice)
), found AS (
  SELECT id, max(containment) AS best, list(DISTINCT label) AS labels FROM met WHERE containment >= 0.9 - 1e-9 GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM cut LEFT JOIN base USING (id) LEFT JOIN found USING (id)
"""


SQL["op4_licenses"] = _license_sql()


SQL["op12_repeated_passages"] = r"""
WITH cut AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT id, s, array_to_string(words[s + 1 : s + 35], ' ') AS held FROM (SELECT id, words, unnest(range(len(words) - 34)) AS s FROM cut)
), gone AS (
  SELECT DISTINCT id, unnest(range(s, s + 35)) AS p FROM windows WHERE held IN (SELECT held FROM windows GROUP BY held HAVING count(*) > 1)
), placed AS (
  SELECT id, unnest(words) AS word, unnest(range(len(words))) AS p FROM cut
), kept AS (
  SELECT id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS held, count(gone.p) AS n_removed
  FROM placed LEFT JOIN gone USING (id, p) GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(held, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (id)
"""


def _vector_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every part compared with every entry, round after round."""
    near = """SELECT rid, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT rid, c.p, e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM cut c JOIN b{r} b ON b.p = c.p) GROUP BY rid, p"""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS MATERIALIZED ({near.format(r=r)}
), s{r} AS (
  SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM (
    SELECT p, e, i, sum(v)::BIGINT AS total, count(*) AS n
    FROM (SELECT a.p, a.e, unnest(c.x) AS v, unnest(range(len(c.x))) AS i FROM a{r} a JOIN cut c USING (rid, p)) GROUP BY p, e, i
  ) GROUP BY p, e
), b{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(s.x, b.x) AS x FROM b{r} b LEFT JOIN s{r} s USING (p, e)
), """)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT rid, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) r(p)
), b0 AS (
  SELECT p, rid - 1 AS e, x FROM cut WHERE rid <= {entries}
), {"".join(steps)}coded AS ({near.format(r=rounds)}
), found AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM coded GROUP BY rid
), entries AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM found JOIN kept USING (rid), entries
"""


SQL["op13_vector_codes"] = _vector_sql()
