"""The pipeline's stages: each keeps what it should, in order, and survives odd rows."""

from __future__ import annotations

import corpus_pipeline
import pandas as pd
from test_operators import ODD, brute_components, docs_of


def test_order_and_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == cols
        docs = docs.cache()
        kept.append(docs.toPandas())
    before = pd.read_parquet(f"{sf}/documents.parquet")
    toxic = set(before.doc_id) - set(kept[0].doc_id)
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").toxic
    assert sum(labels.get(i, 1) == 0 for i in toxic) <= 2  # fitted on some eighty labels
    assert set(kept[1].doc_id) == set(kept[0].groupby("text").doc_id.max())
    parts = brute_components(dict(zip(kept[1].doc_id, kept[1].text, strict=True)), 5, 80)
    assert set(kept[2].doc_id) == {c for _, c in parts.values()}
    assert set(kept[3].doc_id) <= set(kept[2].doc_id)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(out.doc_id) == set(kept[3].doc_id)
    assert out.round_trip.all()
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(whole.doc_id) == sorted(out.doc_id)


def test_odd_rows(spark, sf):
    for rows in (ODD, []):
        docs = docs_of(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).cache()
        assert docs.count() <= len(rows)
        assert not rows or docs.count() >= 8
