"""License scans against all blocks and notices, phrase places, and plans without Python."""

import re

from llm.cases import awkward, empty

from findery.llm import licenses
from findery.llm.queries import op4_licenses

OWN = (("one", "alpha beta gamma delta epsilon"), ("two", "the quick brown fox jumps over it"))


def plain(text, notices, threshold):
    words = [w for w in re.split(licenses.SPLIT, (text or "").lower()) if w]
    at = [
        (i, label) for phrase, label in licenses.PHRASES for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    step = max(len(licenses.plain_words(t)) for _, t in notices)
    best, more = 0.0, set()
    for start in range(0, max(len(words) - step, 1), step):
        held = set(words[start : start + 2 * step])
        for label, notice in notices:
            wanted = set(licenses.plain_words(notice))
            share = len(wanted & held) / len(wanted)
            if share >= threshold - 1e-9:
                best, more = max(best, share), more | {label}
    base = {label for _, label in at}
    starts = [i for i, _ in at]
    return (
        len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | more)), 1.0 if at else best,
    )


def test_equals_all_blocks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame(
        [(900, "x " * 50 + "alpha, beta gamma DELTA. zeta"), (901, "The quick brown fox jumped over it"), (902, "MIT license mit License; apache LICENSE"),
         (903, "beta alpha " + "y " * 30 + "gamma delta epsilon")], "doc_id long, text string")
    docs = docs.unionByName(awkward(spark).select("doc_id", "text")).unionByName(more)
    for notices, threshold in ((OWN, 0.8), (licenses.NOTICES, 0.9)):
        got = [tuple(r) for r in licenses.license_scan(docs, notices, threshold).collect()]
        want = [(d, *plain(t, notices, threshold)) for d, t in docs.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op4_licenses(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert licenses.license_scan(empty(spark)).count() == 0
