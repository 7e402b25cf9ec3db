"""Texts of several MB, which cross the windows and batches of every operator, next to short ones."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from spark_runbook.llm import decontaminate, exact_dedup, imatch, jaccard_join, kd_sharding, packed_ids, shingles, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(seed: int, n: int = 550_000) -> str:
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice([f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(60_000)], n))


@pytest.fixture(scope="module")
def texts():
    """One text, a copy, one with a word in fifty changed, one with another end, another one, and short ones."""
    a = long_text(1)
    words = a.split(" ")
    near = list(words)
    near[::4000] = ["other"] * len(near[::4000])
    assert len(a.encode()) > 3 * shingles.CHUNK_BYTES * 2
    return {1: a, 2: a, 3: " ".join(near), 4: " ".join([*words[:-1], "tail"]), 5: long_text(2), 6: "short one", 7: "short one", 8: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t)) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def shingle_set(text, q):
    w = [x.lower() for x in text.split(" ")]
    return {tuple(w[i : i + q]) for i in range(len(w) - q + 1)} or {tuple(w)}


def test_jaccard(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, 3, 90).collect()}
    sets = {i: shingle_set(t, 3) for i, t in texts.items() if t}
    assert {i: n for i, (n, _) in got.items() if n} == {i: len(s) for i, s in sets.items()}
    for i in (2, 3, 4):
        assert len(sets[1] & sets[i]) >= 0.9 * len(sets[1] | sets[i])
    assert {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6, 8: 8}


def test_toxicity_features(texts):
    """Features of a long text are those of its parts."""
    a = texts[1].encode()
    at = a.rindex(b" ", 0, len(a) // 2)
    whole, left, right = toxicity.features([a, a[:at], a[at:]])
    assert (whole == np.union1d(left, right)).all()


def test_exact(docs):
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.mark_exact(docs, keep=["doc_id"]).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (7, 2), 7: (7, 2), 8: (8, 1)}


def test_shards(docs):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    got = {r.doc_id: r.shard for r in kd_sharding.kd_shards(docs, {"n": F.col("n_chars")}, size, F.xxhash64("text"), shards=3).collect()}
    assert len(set(got.values())) == 3 and got[6] == got[7]


def test_packed(spark, docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    few = docs.where("doc_id IN (4, 5, 6, 8)")
    from spark_runbook.streaming.stateful import shared_folder

    out = shared_folder(spark, "long")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in packed_ids.read_packed(spark, out, packed_ids.write_packed(few, out, path, 1)).collect()}
    for i in (4, 5, 6, 8):
        ids = np.array([*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_decontamination(spark, docs, texts):
    words = texts[5].split(" ")
    items = spark.createDataFrame([(1, " ".join(words[-10:])), (2, " ".join(words[300_000:300_025])), (3, "nothing of this kind")], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_hit) for r in decontaminate.contamination(docs, items).collect()}
    want = {i: 0 for i in got}
    assert {i: n for i, (n, _) in got.items()} == want | {5: 2} and got[5][1] >= 35


def test_imatch(docs):
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    p = {r.doc_id: r.text for r in imatch.fingerprints(t, ["text"], docs).collect()}
    assert p[1] == p[2] and p[6] == p[7] and p[1].startswith("12:")
    like = docs.sparkSession.createDataFrame([(p[1], p[4], p[6])], "a string, b string, c string").select(imatch.likeness(F.col("a"), F.col("b")).alias("near"), imatch.likeness(F.col("a"), F.col("c")).alias("far")).first()
    assert like.near > 0.8 and like.far == 0


def test_stages(spark, sf, docs):
    """A long clean text goes through the whole pipeline, of its copies and near copies one."""
    some = docs.where("doc_id IN (2, 4, 5, 6)").unionByName(spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") < 10, F.col("doc_id") + 10_000).otherwise(F.col("doc_id"))).select("doc_id", "text", "lang", "source", "n_chars"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        some = stage(spark, some, sf).cache()
    kept = {r.doc_id for r in some.select("doc_id").collect()}
    assert {2, 5, 6} <= kept and 4 not in kept
    out = {r.doc_id: r.round_trip for r in corpus_pipeline.STAGES[-1][1](spark, some.where("doc_id < 10"), sf).collect()}
    assert out == {2: True, 5: True, 6: True}
