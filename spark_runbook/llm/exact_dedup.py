"""Exact duplicates by two-pass Bloom filtering.

Pass one puts the 64-bit hash of every text into a two-bit Bloom filter of fixed size (``bloom.py``). Pass two probes it: a text
whose bits were not set twice is certainly alone and passes straight through; only the rest shuffle, by SHA-256 of the text.
Groups are aggregated before the shuffle, and the join back deals the rows of a large group over many tasks.

Defined results: null text counts as empty; empty texts are equal to each other; of equal texts the row with the largest id stays
(null ids are smallest); of rows that share text and id one stays; an empty table gives an empty result; texts of any length are hashed whole; ``mark_exact``
gives the columns it adds their names, in place of input columns so named; ``drop_exact`` returns all input columns as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import LOG2_BITS, maybe_repeated, repeated_filter
from .common import cut, heavy_keys, renamed, spread_join, text_or_empty

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, log2_bits: int = LOG2_BITS) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, with keep_id, group_size, kept and text_sha256."""
    bits = repeated_filter(docs.select(F.xxhash64(text_or_empty(text_col)).alias("h")), log2_bits)

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(maybe_repeated(h.to_numpy(np.int64).view(np.uint64), bits.value, log2_bits))

    keep = [c for c in (keep or docs.columns) if c not in ADDED]
    probed = docs.select(*keep, F.col(id_col).alias("__id"), F.sha2(text_or_empty(text_col), 256).alias("text_sha256"), repeated(F.xxhash64(text_or_empty(text_col))).alias("__again"))
    alone = probed.where(~F.col("__again")).select(*keep, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = cut(probed.where("__again").drop("__again").withColumn("__row", F.monotonically_increasing_id()))
    best = cut(again.groupBy("text_sha256").agg(F.max(F.struct("__id", "__row")).alias("__best"), F.count("*").alias("group_size")))
    marked = spread_join(again, best, "text_sha256", heavy_keys(best, "text_sha256", "group_size"), F.col("__row")).select(*keep, F.col("__best.__id").alias("keep_id"), "group_size", (F.col("__row") == F.col("__best.__row")).alias("kept"), "text_sha256")
    return alone.unionByName(marked)


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that lose to an equal text; same columns, whatever their names."""
    plain, (i, t), restore = renamed(docs, id_col, text_col)
    return restore(mark_exact(plain, i, t).where("kept"))


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mark_exact(docs, keep=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
