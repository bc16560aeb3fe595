"""Near duplicates against all pairs."""

import random
import re

from llm.cases import awkward, empty
from pyspark.sql import functions as F

from findery.llm import near_dups
from findery.llm.components import components


def plain(rows, threshold=0.8, n=5):
    """Class and links by (doc_id, text), over all pairs of different shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        width = min(n, len(words))
        sets.append(frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset())
    names = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    parent = list(range(len(names)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, different = [0] * len(names), list(names)
    owners = {}
    for s, i in names.items():
        for g in s:
            owners.setdefault(g, []).append(i)
    for i, a in enumerate(different):
        shared = {}
        for g in a:
            for j in owners[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if k >= 0.8 * (len(a) + len(different[j]) - k):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for (doc_id, _), s in zip(rows, sets, strict=True):
        if s and doc_id is not None:
            at = root(names[s])
            ids[at] = min(ids.get(at, doc_id), doc_id)
    return [
        (doc_id, ids.get(root(names[s])) if s else doc_id, links[names[s]] if s else 0)
        for (doc_id, _), s in zip(rows, sets, strict=True)
    ]


def test_equals_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(awkward(spark).select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text")).coalesce(3)
    got = near_dups.near_duplicates(docs)[0].select("doc_id", "class_id", "n_links").collect()
    want = plain([tuple(r) for r in docs.collect()])
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_a_large_group_is_dealt_into_blocks(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 3)):
            words[at] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string")
    found, _, _, _ = near_dups.near_duplicates(docs, block=16)
    got = found.select("doc_id", "class_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows * 3))
    assert found.where("representative").count() == len({r[1] for r in plain(rows)})


def test_bands_reach_the_recall():
    bands, rows = near_dups.choose_bands(0.8, 0.999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(20)]
    got = dict(map(tuple, components(spark.createDataFrame([*chain, (None, 3)], "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61))
    assert all(got[a] == got[b] and got[a] <= a for a, b in chain if a != b)


def test_stage_and_awkward_rows(spark):
    docs = awkward(spark)
    kept = near_dups.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # 5 (twice) and 10 have one set; rows without words stay, each alone.
    assert len([r for r in rows if r.doc_id == 5]) == 1 and not [r for r in rows if r.doc_id == 10]
    assert {7, 8, 9, None, 11, 12, -3} <= {r.doc_id for r in rows}
    assert near_dups.one_of_each(empty(spark)).count() == 0
