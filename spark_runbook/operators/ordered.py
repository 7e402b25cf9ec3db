"""Ordered scans over keys of any size: running sums, counts, extremes and last known values, taken in ranges of the order with a carry.

A window over a whole key is one task for that key. Here rows are dealt by ranges of (key, order), so a key of any number of rows lies in
many ranges. Each range is scanned on its own; what a range's first key needs of the ranges before is one row (sums, extremes and last values are
associative), so the carry has at most one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART, POS = "__part", "__pos"


def deal(df: DataFrame, by: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """df with ``__part``, the range of (by, order) that a row lies in, and ``__pos``, which rises with the order, ties included. Rows are written and read
    again: ranges come from a sample, and what is counted in them must be what is scanned in them."""
    from ..streaming.stateful import shared_folder

    spark = df.sparkSession
    made = df.repartitionByRange(chunks or int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).sortWithinPartitions(*by, *order)
    made = made.select("*", F.spark_partition_id().alias(PART), F.monotonically_increasing_id().alias(POS))
    made.write.parquet(path := shared_folder(spark, "dealt"))
    return spark.read.schema(made.schema).parquet(path)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys, in which null is a key like others."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys))


def join_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to b by keys that may be null; the columns of a, then those of b without the keys."""
    named = b.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    on = reduce(lambda x, y: x & y, (a[k].eqNullSafe(named[f"__k{i}"]) for i, k in enumerate(keys)))
    return a.join(named, on, how).drop(*(f"__k{i}" for i in range(len(keys))))


_WITHIN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
_OVER_PARTS = _WITHIN | {"count": F.sum}


def _joined(kind: str, inside: Column, carry: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(inside.isNull() & carry.isNull(), None).otherwise(F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return F.coalesce(inside, carry) if kind == "last" else (F.greatest if kind == "max" else F.least)(inside, carry)


def running(dealt: DataFrame, by: list[str], **columns: tuple[str, Column, bool]) -> DataFrame:
    """dealt (of ``deal`` with the same keys) with a column for each of ``columns``: name=(kind, value, inclusive). kind is sum, count (of values that aren't
    null), max, min or last (the last value that isn't null); inclusive says whether the row itself counts. Null where there was nothing; counts are 0."""
    values = dealt.select("*", *(v.alias(f"__v_{n}") for n, (_, v, _i) in columns.items()))
    whole = lambda kind, c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(POS))) if kind == "last" else _WITHIN[kind](c)
    totals = values.groupBy(*by, PART).agg(*(whole(kind, f"__v_{n}").alias(f"__t_{n}") for n, (kind, _, _i) in columns.items()))
    before = Window.partitionBy(*by).orderBy(PART)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*by, PART, F.lag(PART).over(before).alias("__b"), *(_OVER_PARTS[kind](f"__t_{n}").over(earlier).alias(f"__c_{n}") for n, (kind, _, _i) in columns.items()))
    carry = F.broadcast(carry.where("__b IS NOT NULL").drop("__b"))  # a row a range at most: only a range's first key began before it
    w = Window.partitionBy(PART, *by).orderBy(POS)
    inside = values.select("*", *(_WITHIN[kind](f"__v_{n}").over(w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)).alias(f"__i_{n}") for n, (kind, _, inclusive) in columns.items()))
    out = join_keys(inside, carry, [*by, PART], "left")
    return out.select(*dealt.columns, *(_joined(kind, F.col(f"__i_{n}"), F.col(f"__c_{n}")).alias(n) for n, (kind, _, _i) in columns.items()))


def scan(df: DataFrame, by: list[str], order: list[str], chunks: int | None = None, **columns: tuple[str, Column, bool]) -> DataFrame:
    """``deal`` and ``running`` in one, without the ranges."""
    return running(deal(df, by, order, chunks), by, **columns).drop(PART, POS)
