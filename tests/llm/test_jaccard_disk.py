"""What the n-gram Jaccard join writes: shingles that one node has alone, nodes that only share a frequent shingle, and shuffle files of steps that are done don't stay."""

from __future__ import annotations

import glob
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from spark_runbook.llm import common, jaccard_join, shingles
from test_operators import brute_components, docs_of


@pytest.mark.parametrize(("part", "rows"), [(250_000, 50_000), (50, 7)])
def test_shingles_of_one_node(spark, monkeypatch, part, rows):
    """Just the shingles of several nodes stay, each entry once, whatever the number of parts, a hot shingle among them."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "ROWS", rows)
    rnd = np.random.default_rng(3)
    made = {i: [-5, *sorted({int(x) for x in rnd.integers(-(2**62), 2**62, i % 9)} | {int(x) for x in rnd.integers(0, 400, 3)})][i % 4 == 0 :] for i in range(0, 300 << 20, 1 << 20)}
    count = Counter(h for p in made.values() for h in p)
    want = sorted((i, len(p) + 7, 2, k, h) for i, p in made.items() for k, h in enumerate(p) if count[h] > 1)
    nodes = spark.createDataFrame([(i, len(p) + 7, 2, p) for i, p in made.items()], "nid long, n int, l int, prefix array<long>").repartition(5)
    got = jaccard_join._repeated(nodes, sum(count.values()))
    assert got.columns == ["nid", "n", "l", "k", "h"]
    assert sorted(map(tuple, got.collect())) == want
    assert jaccard_join._repeated(nodes.limit(0), 0).count() == 0


def test_far_nodes_of_a_long_list(spark, monkeypatch):
    """Texts that share some shingles of one passage, where the corpus is so large that the sketch can't tell its frequency: they are told apart without differences to a hub; two near copies and a chain among them are linked."""
    monkeypatch.setattr(jaccard_join, "frequency_levels", lambda texts, q: common.Shared(spark, np.zeros(1 << shingles.LOG2_COUNTERS, np.uint8)))
    rnd = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(30)]
    t = {i: " ".join([*(f"w{x}" for x in rnd.integers(0, 10**9, 300)), *passage]) for i in range(120)}
    t[200], t[201], t[202] = t[7] + " z", t[7] + " z y", t[8].replace(" p9 ", " q9 ")
    counts = []
    out = jaccard_join.jaccard_components(docs_of(spark, t.items()), 3, 90, counts=counts).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == brute_components(t, 3, 90)
    assert got[201][1] == 7 and got[202][1] == 8
    assert not [c for c in counts if c[0] == "differences"]


def test_long_key_lists(spark, monkeypatch):
    """Key lists too long to broadcast give the same rows."""
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", 0)
    rnd = np.random.default_rng(12)
    t = {i: " ".join(f"w{x}" for x in rnd.integers(0, 10**9, 60)) for i in range(30)} | {40: None, 41: ""}
    t |= {50 + i: t[i] + " z" for i in range(10)} | {70: t[3]}
    docs = docs_of(spark, t.items())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()} == brute_components(t, 3, 90)
    assert sorted(r.doc_id for r in jaccard_join.drop_near(docs).collect()) == [*range(30), 40, 41]


def test_shuffle_files_go(spark):
    left = lambda: {f for f in glob.glob(f"{spark.conf.get('spark.local.dir')}/blockmgr-*/*/shuffle_*.data")}
    was, setting = left(), spark.conf.get(common.SHUFFLES_GO)
    out = common.cut(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 20
    while left() - was and time.time() < until:
        time.sleep(0.2)
    assert not left() - was
    assert spark.conf.get(common.SHUFFLES_GO) == setting
    assert out.where("n = 10").count() == 1000
