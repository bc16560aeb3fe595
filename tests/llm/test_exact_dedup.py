"""Exact de-duplication against grouping by the texts themselves."""

import hashlib
import re
from collections import defaultdict

import pytest
from llm.cases import awkward, empty

from findery.llm.exact_dedup import deduplicate, distinct_documents


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for text, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[3], keep, len(members), sha) for m in members]
    return sorted(out, key=repr), len(groups)


@pytest.mark.parametrize("width, files", [(32, None), (32, 1), (1, 2)])
def test_equals_grouping_by_text(spark, sf_dir, width, files):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(awkward(spark).select("doc_id", "text")).repartition(5)
    want, groups = plain([tuple(r) for r in docs.collect()])
    got = deduplicate(docs, files, width).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups and all(r.doc_id == r.keep_id for r in kept)


def test_stage_keeps_columns_and_one_row_of_each(spark):
    docs = awkward(spark)
    kept = distinct_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {-3, 9, 10, 11, 12, None} and kept.count() == 6


def test_empty_table(spark):
    assert deduplicate(empty(spark)).count() == 0
    assert distinct_documents(empty(spark)).count() == 0
