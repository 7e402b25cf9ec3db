"""The corpus pipeline: STAGES in order, each a call of one operator; run() applies them to documents.

All stages but the last return the columns of documents. ORACLE_SQL is None: the classifier and the transducer can't be put in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spark_runbook.llm import common, decontaminate, exact_dedup, jaccard_join, piece_fst, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 in shingles of five words, the smallest id stays."""
    return jaccard_join.drop_near(docs, q=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and whether they decode to its text."""
    import public_tokenizers

    return piece_fst.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("n-gram Jaccard join", near), ("benchmark decontamination", clean), ("SentencePiece", pieces)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written and read again by the next, as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        docs.write.parquet(path := f"{common.shared_dir(spark)}/stage-{uuid.uuid4().hex}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
