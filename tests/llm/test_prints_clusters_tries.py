"""I-Match fingerprints, exact clustering and the prefix trie: against SQL on hand-made tables, brute force, and on odd inputs."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import same_rows
from pyspark.sql import functions as F
from spark_runbook.llm import centroids, imatch, prefix_trie


def con_of(**tables: pd.DataFrame):
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"{name}_rows", t)
        con.sql(f"CREATE TABLE {name} AS FROM {name}_rows")
    return con


def saved(df, path, name):
    df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# 11

DOCS = "doc_id long, text string, t string, next string, __id int, df int"
WORDS = [f"w{i}é" for i in range(400)]


def prose(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


ODD = [(4, None), (1, ""), (7, " \t "), (9, "one"), (10, "one"), (12, "ONE, two"), (15, prose(1, 50)), (16, prose(1, 50)), (18, prose(2, 3000)), (20, prose(3, 5) + " 😀😀😀"), (22, "the " * 500), (23, prose(4, 120_000)), (30, "x" * 100_000), (31, prose(1, 49) + " other")]


def test_imatch_odd(spark, tmp_path):
    rows = [(i, t, "t", None, 1, 2) for i, t in ODD]
    out = imatch.op11_imatch(spark, saved(spark.createDataFrame(rows, DOCS).repartition(3), tmp_path, "documents"))
    same_rows(out, con_of(documents=pd.DataFrame(ODD, columns=["doc_id", "text"])), imatch.OP11_SQL)
    got = {r.doc_id: r for r in out.collect()}
    assert got[15].fingerprint == got[16].fingerprint and got[15].near_next == 1.0
    assert got[31].near_next < 1 and got[1].near_edited == 1.0
    assert got[9].fingerprint[0] == got[12].fingerprint[0] == "0"


def test_imatch_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, prose(1, 40)), (1, prose(1, 40)), (1, prose(2, 40)), (None, prose(3, 40)), (None, prose(3, 40))]
    out = imatch.op11_imatch(spark, saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")).collect()
    assert len(out) == 5 and sum(r.doc_id is None for r in out) == 2
    assert len({(r.doc_id, r.fingerprint, r.edited_sha256, r.near_next) for r in out}) == 3


def test_imatch_one_and_none(spark, tmp_path):
    one = imatch.op11_imatch(spark, saved(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string"), tmp_path / "a", "documents")).first()
    assert (one.doc_id, one.n_chars, one.near_next) == (5, 9, 1.0)
    assert imatch.op11_imatch(spark, saved(spark.createDataFrame([], "doc_id long, text string"), tmp_path / "b", "documents")).count() == 0


def test_imatch_hot_terms(spark, tmp_path):
    """Terms of a third of all documents are in the band here and dealt over many tasks; one of all documents is above it."""
    rows = [(i, f"every w{i % 3} pair{i // 2} c{i // 40}") for i in range(1200)]
    out = imatch.op11_imatch(spark, saved(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents"))
    same_rows(out, con_of(documents=pd.DataFrame(rows, columns=["doc_id", "text"])), imatch.OP11_SQL)


def test_followers_over_ranges(spark):
    keys = spark.range(1, 500).select((F.col("id") * 37 % 499).alias("a"), F.col("id").alias("b"))
    want = sorted((r.a, r.b) for r in keys.collect())
    got = {(r.a, r.b): tuple(r.next) for r in imatch.followers(keys.repartition(7), ["a", "b"]).collect()}
    assert got == dict(zip(want, want[1:] + want[:1], strict=True))


def test_df_bounds():
    assert imatch.df_bounds(1 << 20) == (2, 131072) and imatch.df_bounds(0) == (1, 0) and imatch.df_bounds(1) == (1, 1)


def test_imatch_is_native(spark, sf):
    plan = imatch.op11_imatch(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "MapInBatch"))


# 12


def embedded(rows):
    return pd.DataFrame(rows, columns=["vec_id", "embedding"])


def clustered(n: int, groups: int, seed: int = 1):
    g = np.random.default_rng(seed)
    middle = g.normal(0, 3, (groups, 64))
    return [(int(i), (middle[i % groups] + g.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(n)]


def test_loosening_is_a_bound():
    """No vector of a sphere, on its centroid's side, comes closer to a moved centroid by more than the bound; which is often far less than the drift."""
    g = np.random.default_rng(5)
    tighter = 0
    for _ in range(60):
        old = g.normal(0, 10, (6, 3)).round()
        new = (old + g.normal(0, g.choice([0.3, 3, 8]), old.shape)).round()
        x = old[g.integers(0, 6, 4000)] + g.normal(0, g.choice([0.5, 4]), (4000, 3))
        d = np.linalg.norm(x[:, None] - old[None], axis=2)
        own = d.argmin(1)
        radius = np.array([d[own == j, j].max(initial=0) for j in range(6)])
        loss = centroids.loosened(old, new, radius)
        closer = d - np.linalg.norm(x[:, None] - new[None], axis=2)
        closer[np.arange(len(x)), own] = 0
        assert (closer.max(1) <= loss[own] + 1e-9).all()
        drift = np.linalg.norm(new - old, axis=1)
        tighter += sum(loss[j] < 0.9 * np.delete(drift, j).max() for j in range(6))
    assert tighter > 100


def test_bounds_spare_scans(monkeypatch):
    calls = []
    whole = centroids.scanned
    monkeypatch.setattr(centroids, "scanned", lambda v, c: calls.append(len(v)) or whole(v, c))
    v = np.floor(64 * np.array([x for _, x in clustered(3000, 16)], np.float32).astype(float)).astype(np.int64)
    c = v[:16] + 3
    own, d, low = whole(v, c)
    up = np.sqrt(d)
    new = np.array([v[own == j].sum(0) // (own == j).sum() for j in range(16)])
    loss = centroids.loosened(c, new, np.array([up[own == j].max() for j in range(16)]))
    sure = up + np.sqrt(((new - c) ** 2).sum(1))[own] < low - loss[own]
    assert sure.mean() > 0.9 and (whole(v[sure], new)[0] == own[sure]).all()


@pytest.mark.parametrize("rows", [clustered(400, 7), clustered(20, 3), [(i, [0.5] * 64) for i in range(40)], [(1, [0.25] * 64)] * 5, [(i, [float(i % 2), *[0.0] * 63]) for i in range(30)]], ids=["groups", "few", "equal", "repeated", "ties"])
def test_clusters_against_sql(spark, tmp_path, rows):
    sf = saved(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), tmp_path, "embeddings")
    same_rows(centroids.op12_centroids(spark, sf), con_of(embeddings=embedded(rows)), centroids.OP12_SQL)


def test_clusters_odd(spark, tmp_path):
    bad = [(100, None), (101, [1.0] * 63), (102, [*[1.0] * 63, None]), (103, [*[1.0] * 63, float("nan")]), (104, [*[1.0] * 63, float("-inf")]), (105, [])]
    good = [*clustered(30, 3), (None, [0.1] * 64)]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in good + bad], "vec_id long, embedding array<float>, c int, u double, part string")
    out = centroids.op12_centroids(spark, saved(df, tmp_path / "a", "embeddings"))
    assert sorted((r.vec_id for r in out.collect()), key=str) == sorted((i for i, _ in good), key=str)
    empty = df.where("vec_id > 1000")
    assert centroids.op12_centroids(spark, saved(empty, tmp_path / "b", "embeddings")).count() == 0
    large = spark.createDataFrame([(1, [3e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        centroids.op12_centroids(spark, saved(large, tmp_path / "c", "embeddings")).count()


def test_exact_distances():
    g = np.random.default_rng(2)
    for most in (50, 1 << 20, centroids.limit(64) - 1):
        v, c = (g.integers(-most, most + 1, (n, 64)) for n in (9, 4))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        assert centroids.distances(v, c).tolist() == want


# 13

TURNS = "conv_id long, turn long, role string, text string, d int, f string, part long"


def trie_of(spark, path, rows):
    df = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], TURNS).repartition(3)
    return prefix_trie.op13_prefix_trie(spark, saved(df, path, "conversations"))


def talks(rows):
    return con_of(conversations=pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))


def test_trie_odd(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else None, None if (c + t) % 5 == 0 else f"say {t % 3} {c % 2}") for c in [0, 3, 7, 41, 100, 102, 199, 305, -5, -120] for t in range(c % 9)]
    rows += [(41, None, "user", "first"), (41, 2, "a", "tie"), (41, 2, "a", "tie"), (41, 2, "B", "tie é"), (12, 0, None, None), (13, 0, "", ""), (100, 1, "user", "x" * 300_000), (101, 5, "user", "x" * 300_000)]
    same_rows(trie_of(spark, tmp_path, [*rows, (None, 1, "user", "nobody's")]), talks(rows), prefix_trie.OP13_SQL)


def test_trie_of_long_and_common_conversations(spark, tmp_path):
    """A third of all turns is one conversation, which spans ranges, and many others are copies of each other."""
    rows = [(5, t, "user", f"t{t}") for t in range(900)] + [(5 + 100 * k, t, "user", f"t{t}") for k in (1, 2) for t in range(400)] + [(1000 + c, t, "user", "same") for c in range(300) for t in range(3)]
    same_rows(trie_of(spark, tmp_path, rows), talks(rows), prefix_trie.OP13_SQL)


def test_trie_empty(spark, tmp_path):
    assert trie_of(spark, tmp_path, []).count() == 0


def test_trie_verifies_groups(spark):
    """Fingerprints that are all equal fail the check and are drawn anew."""
    df = spark.createDataFrame([(c, t, "u", f"{c} {t}") for c in range(4) for t in range(8)], "conv_id long, turn long, role string, text string")
    key = ["conv_id", "depth", "n_convs", "saved_tokens", "ends_sha256"]
    bad = prefix_trie.trie(df, bases=[(0, 0), (12345, 678910)]).select(key).collect()
    assert sorted(bad) == sorted(prefix_trie.trie(df).select(key).collect())


def test_trie_turns_are_references(spark):
    rows = [(0, 1, "user", "hi"), (0, 2, "bot", "yes"), (1, 1, "user", "hi"), (1, 2, "bot", "no")]
    plan = lambda c: c.select("conv_id", F.col("conv_id").alias("base_id"), F.lit(0).alias("h"))
    got = {(r.depth, r.turn and tuple(r.turn)) for r in prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), plan).collect()}
    assert got == {(0, None), (1, (0, 1)), (2, (0, 2)), (2, (1, 2))}


def test_chunked_digests(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ids = list(range(-20, 500, 3))
    ends = spark.createDataFrame([(1, 10, c) for c in ids] + [(2, 10, 4), (0, 0, 9)], "d long, f long, c long").repartition(5)
    got = {(r.d, r.f): r.ends_sha256 for r in prefix_trie._digests(ends).collect()}
    assert got == {(d, f): hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for d, f, x in [(1, 10, ids), (2, 10, [4]), (0, 0, [9])]}
