"""Vector codes against plain arithmetic over all entries."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from findery.llm.vector_codes import nearest, roots, spread_pivots, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, whole string"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(v, [math.floor(4096 * x) for x in e], lab) for v, e, lab in rows
            if e is not None and len(e) and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    cut = [[r[1][p * size:(p + 1) * size] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def near(p, x):
        return min((far(x, e), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(p, c[p])[1]].append(c[p])
            for i, xs in members.items():
                books[p][i] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for (v, _, lab), c in zip(kept, cut, strict=True):
        got = [near(p, c[p]) for p in range(parts)]
        error = sum(g[0] for g in got)
        by[lab] += error
        out.append((v, "".join(f"{g[1]:02x}" for g in got), error, lab))
    return sorted(((v, code, e, by[lab], sha) for v, code, e, lab in out), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_equals_plain_arithmetic(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(300).repartition(4)
    want = plain([(r.vec_id, r.embedding, r.label) for r in rows.select("vec_id", "embedding", "label").collect()])
    assert got(vector_codes(rows)) == want


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)], i % 3 or None, 1, "w") for i in range(40)]
    rows += [(None, [0.5] * 8, 1, 1, "w"), (7, [0.25] * 8, None, 1, "w"), (7, [0.25] * 8, None, 1, "w")]
    bad = [(90, None, 1, 1, "w"), (91, [1.0] * 7 + [None], 1, 1, "w"), (92, [float("nan")] * 8, 1, 1, "w"),
           (93, [float("inf")] + [0.0] * 7, 1, 1, "w"), (94, [], 1, 1, "w"), (95, [1.0] * 16, 2, 1, "w"),
           (96, [3e38] * 8, 2, 1, "w")]
    frame = spark.createDataFrame(rows + bad, SCHEMA).repartition(5)
    assert got(vector_codes(frame)) == plain([r[:3] for r in rows])


def test_few_vectors_and_a_length_that_parts_do_not_divide(spark):
    frame = spark.createDataFrame([(2, [1.0] * 9, 0, 1, ""), (1, [0.0] * 9, 0, 1, "")], SCHEMA)
    rows = {r.vec_id: r for r in vector_codes(frame).collect()}
    # Nine components fill five parts of two; the other three are zeros, alike in all entries.
    assert rows[1].code == "00" * 8 and rows[2].code == "01" * 5 + "00" * 3 and rows[1].error == rows[2].error == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes(empty).count() == 0
    assert vector_codes(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)).columns == vector_codes(empty).columns


@pytest.mark.parametrize("scale", [1, 10_000])
def test_pivots_prune_and_keep_ties_exact(scale):
    rng = np.random.default_rng(scale)
    parts = rng.integers(-50, 50, (4000, 6)) * scale
    book = np.concatenate([parts[:12], parts[:4]])  # repeated entries: ties go to the lower index
    pivots = spread_pivots(book, 4)
    index, best, tried = nearest(parts, book, roots(parts, pivots).astype(np.float32), pivots)
    far = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
    assert tried < 0.7 * far.size
