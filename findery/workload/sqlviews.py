"""DuckDB twins of the derived frames: plain columns, fields as ``f_<name>``."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

_DOC_TEXT = """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_key, 1000 + d.doc_id AS node_id,
  array_to_string(string_split_regex(d.text, '[ \\t\\r\\n]+')[1:6], ' ') AS name,
  d.source AS type_alias, 'content' AS index_type, '{index}' AS index_name, {rank} AS index_rank,
  [CAST(-1 AS BIGINT), 1 + CAST(substring(d.source, 4) AS BIGINT), 1000 + d.doc_id] AS path,
  d.lang AS culture, d.text AS f_bodytext, CAST(d.n_chars AS VARCHAR) AS f_n_chars,
  CASE WHEN l.quality = 1 THEN 'y' WHEN l.quality IS NOT NULL THEN 'n' END AS f_published,
  CASE WHEN l.toxic = 1 THEN '1' END AS f_hidefromsearch
FROM documents d {join} labels l ON l.doc_id = d.doc_id
"""
VIEWS["docs_text"] = _DOC_TEXT.format(index="main", rank=0, join="LEFT JOIN")
VIEWS["docs_mirror"] = _DOC_TEXT.format(index="mirror", rank=1, join="JOIN")
VIEWS["docs_both"] = "SELECT * FROM docs_text UNION ALL SELECT * FROM docs_mirror"

VIEWS["docs_pages"] = """
SELECT CAST(page_id AS VARCHAR) AS doc_key, 1000 + page_id AS node_id,
  regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS name,
  CASE WHEN contains(url, '?page=') THEN 'Search-Results' WHEN contains(url, '#') THEN 'searchPanel'
       ELSE 'article' END AS type_alias,
  'content' AS index_type, 'pages' AS index_name, regexp_extract(p, '^/([^/]+)', 1) AS culture,
  html AS f_html, regexp_extract(p, '([^/]*)/*$', 1) AS f_urlname, p AS f_url, url
FROM (SELECT *, regexp_replace(regexp_extract(url, '^https?://[^/]*(/.*)?$', 1), '[?#].*$', '') AS p
      FROM pages)
"""
VIEWS["docs_parts"] = """
SELECT CAST(p_partkey AS VARCHAR) AS doc_key, 1000 + p_partkey AS node_id, p_name AS name,
  p_type AS type_alias, 'content' AS index_type, 'parts' AS index_name,
  [CAST(-1 AS BIGINT), CAST(1 + p_size AS BIGINT), 1000 + p_partkey] AS path,
  p_brand AS f_p_brand, p_size AS n_size, p_retailprice AS n_price,
  p_brand || ',' || p_type AS f_tags, p_partkey
FROM part
"""
VIEWS["docs_orders"] = """
SELECT *, CASE CAST(o_orderkey % 4 AS INT)
    WHEN 0 THEN strftime(day, '%Y%m%d') WHEN 1 THEN strftime(day, '%Y%m%d%H%M%S')
    WHEN 2 THEN CAST(epoch_us(day) * 10 + 621355968000000000 AS VARCHAR)
    ELSE CAST(epoch_us(day) // 1000000 AS VARCHAR) END AS f_orderdate
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS doc_key, 1000 + o_orderkey AS node_id, o_orderkey,
        'Order ' || o_orderkey AS name, o_orderstatus AS type_alias, 'content' AS index_type,
        'orders' AS index_name, o_orderstatus AS f_o_orderstatus,
        o_orderpriority AS f_o_orderpriority, o_totalprice AS n_totalprice,
        o_orderdate + INTERVAL 3652 DAY AS day
      FROM orders)
"""
VIEWS["docs_tree"] = """
SELECT CAST(c_custkey AS VARCHAR) AS doc_key, 1000 + c_custkey AS node_id, c_name AS name,
  c_mktsegment AS type_alias, 'content' AS index_type, 'tree' AS index_name,
  [CAST(-1 AS BIGINT), CAST(1 + n_regionkey AS BIGINT), CAST(100 + n_nationkey AS BIGINT),
   1000 + c_custkey] AS path, c_acctbal, c_custkey, n_regionkey, n_nationkey
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

for _name, _key, _score in (
    ("parts", "p_partkey", "CAST(n_size AS DOUBLE)"), ("orders", "o_orderkey", "n_totalprice"),
    ("tree", "c_custkey", "c_acctbal"),
    ("text", "CAST(doc_key AS BIGINT)", "CAST(f_n_chars AS DOUBLE)"),
    ("both", "CAST(doc_key AS BIGINT)", "CAST(f_n_chars AS DOUBLE)"),
):
    VIEWS[f"hits_{_name}"] = (
        f"SELECT *, CASE WHEN {_key} % 3 = 0 THEN 1000000000 ELSE {_key} // 64 END AS query_id, {_score} AS raw_score, {_score} AS score "
        f"FROM docs_{_name}"
    )

# A stable 60-bit id of a text.
TEXT_ID = "CAST(('0x' || substring(md5({0}), 1, 15)) AS BIGINT)"

_PASSAGE_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
VIEWS["q_text"] = f"""
SELECT query_id, array_to_string(list_filter(w, lambda x, i: NOT list_contains(w[1:i - 1], x)), ' ') AS term
FROM (SELECT item_id AS query_id, {_PASSAGE_WORDS} AS w FROM benchmark)
"""
VIEWS["q_words"] = f"""
SELECT {TEXT_ID.format('term')} AS query_id, term FROM (SELECT DISTINCT unnest({_PASSAGE_WORDS}) AS term FROM benchmark)
"""
VIEWS["q_misspelt"] = f"""
SELECT {TEXT_ID.format('word')} AS query_id, substring(word, 1, 2) || substring(word, 4) AS term
FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)
"""
VIEWS["q_typed"] = f"""
SELECT {TEXT_ID.format('term')} AS query_id, term
FROM (SELECT DISTINCT substring(p_name, 1, instr(p_name, ' ') + 1) AS term FROM part)
"""

VIEWS["search_log"] = """
SELECT event_id AS query_key, 'site' AS profile_alias,
  'k' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 20 AS VARCHAR) AS term,
  'k' || CAST(CAST(json_extract_string(props, '$.k') AS INT) % 20 AS VARCHAR) AS normalized_term,
  CAST(floor(value) AS INT) % 7 AS result_count, CAST(floor(value * 10) AS INT) AS duration_ms,
  CAST(NULL AS VARCHAR) AS culture, ts AS create_date
FROM events WHERE event_type = 'view'
"""
VIEWS["click_log"] = """
SELECT event_id - 1 - event_id % 4 AS query_key, CAST(event_id % 50 AS VARCHAR) AS node_key,
  'Node ' || CAST(event_id % 50 AS VARCHAR) AS node_name,
  1 + CAST(floor(value) AS INT) % 10 AS position, ts AS create_date
FROM events WHERE event_type = 'click'
"""
VIEWS["raw_searches"] = """
SELECT query_key, CASE WHEN k % 11 = 0 THEN 'ad-hoc' ELSE 'site' END AS profile_alias,
  CASE WHEN k % 5 = 0 THEN '   ' WHEN k % 5 = 1 THEN ' q ' ELSE '  Blue   K' || k || ' ' END AS term,
  result_count, duration_ms, 'en-gb' AS culture, create_date
FROM (SELECT event_id AS query_key, CAST(json_extract_string(props, '$.k') AS INT) AS k,
        CAST(floor(value) AS INT) % 7 AS result_count,
        CAST(floor(value * 10) AS INT) AS duration_ms, ts AS create_date FROM events)
"""


# Tokens, postings, vocabulary and statistics of the text index: name, body, culture body.

VIEWS["tok_text"] = """
SELECT index_name, index_type, type_alias, doc_key, field,
  list_filter(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS toks
FROM (SELECT *, 'nodename' AS field, name AS value FROM docs_text
      UNION ALL SELECT *, 'bodytext', f_bodytext FROM docs_text
      UNION ALL SELECT *, 'bodytext_' || culture, f_bodytext FROM docs_text)
"""
VIEWS["post_text"] = """
SELECT index_name, index_type, type_alias, doc_key, field, term, doc_len, count(*) AS tf
FROM (SELECT index_name, index_type, type_alias, doc_key, field, unnest(toks) AS term,
        len(toks) AS doc_len FROM tok_text)
GROUP BY ALL
"""
VIEWS["vocab_text"] = "SELECT index_name, field, term, count(*) AS df FROM post_text GROUP BY ALL"
VIEWS["stats_text"] = """
SELECT index_name, field, count(*) AS n_docs, avg(len(toks)) AS avg_len
FROM tok_text WHERE len(toks) > 0 GROUP BY ALL
"""
VIEWS["words_text"] = """
SELECT query_id, unnest(range(len(w))) AS group_no, unnest(w) AS variant
FROM (SELECT query_id, string_split(term, ' ') AS w FROM q_text)
"""


def bm25_sql(matches: str) -> str:
    """Word weights for a statement giving (query_id, group_no, index_name, field, term)."""
    return f"""SELECT DISTINCT m.query_id, m.group_no, p.index_name, p.field, p.doc_key, p.term,
      p.type_alias, ln(1 + (s.n_docs - v.df + 0.5) / (v.df + 0.5)) * p.tf * 2.2
        / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / s.avg_len)) AS weight
    FROM ({matches}) m
    JOIN post_text p ON p.index_name = m.index_name AND p.field = m.field AND p.term = m.term
    JOIN vocab_text v ON v.index_name = p.index_name AND v.field = p.field AND v.term = p.term
    JOIN stats_text s ON s.index_name = p.index_name AND s.field = p.field"""


def sql(body: str) -> str:
    """A statement with the derived frames it names, and those they name, put in front."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:]}"
    return f"WITH {views}\n{body}"
