"""Sharding by a k-d tree over document metadata.

A node that holds more than one shard's share of the bytes is split at a weighted median along its widest dimension (the one whose
range in the node is the largest part of its range in the table), so that both sides get bytes in proportion to their shards.
The medians of all nodes of a level are found together: a radix descent over 60-bit order keys, 12 bits a pass. A pass is one
grouped sum whose result has at most 4,096 rows a node, so the driver sees a bounded histogram and never a row. The order key is 24
bits of the dimension, 18 of the text's hash and 18 of the id's hash.

Equal texts form groups. All rows of a group take the least metadata that one of them has, so they stand side by side along every dimension, and a cut that falls
into a group moves to the group's nearer edge where that is at most ``SLACK`` of a shard's bytes away. So a group lies in one shard, unless it is larger than about
twice that; then it is split, as sizes come first.

Defined results: null text weighs one byte; null metadata counts as 0; repeated rows are placed one by one; an empty table gives
an empty result; columns that the result adds replace columns of those names.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join, text_or_empty, utf8_bytes

BITS, DIGIT = 60, 12
DIM_MAX = (1 << 24) - 1
GROUP_BITS = 18
SLACK = 0.02


def _by_node(node: Column, values: dict[int, Column]) -> Column:
    return reduce(lambda acc, kv: acc.when(node == kv[0], kv[1]), list(values.items())[1:], F.when(node == next(iter(values)), next(iter(values.values()))))


def _tree(splits: dict[int, tuple[str, int]], leaf: dict[int, int] | None = None, n: int = 1) -> Column:
    """The node of a row under these splits, or its leaf's number."""
    if n not in splits:
        return F.lit(leaf[n] if leaf else n)
    dim, at = splits[n]
    return F.when(F.col(f"__k_{dim}") <= at, _tree(splits, leaf, 2 * n)).otherwise(_tree(splits, leaf, 2 * n + 1))


def _medians(rows: DataFrame, node: Column, goals: dict[int, float], dims: dict[int, str], slack: float) -> dict[int, int]:
    """For each node, the order key up to which its rows go left. goals: bytes to the left; slack: how far from them the edge of a group may lie."""
    prefix, below = dict.fromkeys(goals, 0), dict.fromkeys(goals, 0)
    cuts = {}
    for p in range(BITS // DIGIT):
        key = _by_node(F.col("__node"), {n: F.col(f"__k_{dims[n]}") for n in goals})
        at = rows.withColumn("__node", node).where(F.col("__node").isin(list(goals))).withColumn("__key", key)
        at = at.where(F.shiftright("__key", BITS - DIGIT * p) == _by_node(F.col("__node"), {n: F.lit(v) for n, v in prefix.items()}))
        digit = F.shiftright("__key", BITS - DIGIT * (p + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))
        found: dict[int, list] = {n: [] for n in goals}
        for r in at.groupBy("__node", digit.alias("digit")).agg(F.sum("__w").alias("w")).collect():  # at most 4,096 rows a node
            found[r["__node"]].append((r["digit"], r["w"]))
        for n, hist in found.items():
            acc = below[n]
            for digit_value, w in sorted(hist):
                last = digit_value
                if acc + w >= goals[n]:
                    break
                acc += w
            else:
                acc -= w
            below[n], prefix[n] = acc, (prefix[n] << DIGIT) | last
    for n in goals:
        cuts[n] = prefix[n]
    final = rows.withColumn("__node", node).where(F.col("__node").isin(list(goals)))
    key, at = _by_node(F.col("__node"), {n: F.col(f"__k_{dims[n]}") for n in goals}), _by_node(F.col("__node"), {n: F.lit(v) for n, v in cuts.items()})
    edge = final.where(F.shiftright(key, GROUP_BITS) == F.shiftright(at, GROUP_BITS)).groupBy("__node")
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("__w"))), F.lit(0))
    around = {r["__node"]: r for r in edge.agg(side(key < at).alias("less"), side(key == at).alias("here"), F.sum("__w").alias("group")).collect()}
    return {n: _cut_at(c, below[n], around[n], goals[n], slack) for n, c in cuts.items()}


def _cut_at(key: int, below: int, around, goal: float, slack: float) -> int:
    """The nearer edge of the key's group, if that is near enough, else the nearer side of the key. below: the weight of smaller keys; around: the weight of the
    group's smaller keys, of the key (that of one row, or of rows that tie in all 60 bits), and of the whole group."""
    first = key >> GROUP_BITS << GROUP_BITS
    before = below - around["less"]
    edges = [(abs(before - goal), first - 1), (abs(before + around["group"] - goal), first + (1 << GROUP_BITS) - 1)]
    off, at = min(edges)
    if off <= slack:
        return at
    return key if below + around["here"] - goal <= goal - below else key - 1


def _of_groups(base: DataFrame, dims: list[str]) -> DataFrame:
    """base with the least metadata of each group of equal texts for all its rows. Only groups whose rows differ are joined, large ones dealt over tasks."""
    ends = [f(f"__d_{n}").alias(f"{g}_{n}") for n in dims for g, f in (("lo", F.min), ("hi", F.max))]
    mixed = base.groupBy("__t").agg(F.count("*").alias("n"), *ends).where(" OR ".join(f"lo_{n} < hi_{n}" for n in dims))
    mixed = cut(mixed.select("__t", "n", *(F.col(f"lo_{n}").alias(f"__m_{n}") for n in dims)))
    joined = spread_join(base, mixed.drop("n"), "__t", heavy_keys(mixed, "__t", "n"), F.col("__i"), "left")
    return cut(joined.select(*(c for c in base.columns if not c.startswith("__d_")), *(F.coalesce(f"__m_{n}", f"__d_{n}").alias(f"__d_{n}") for n in dims)))


def kd_shards(docs: DataFrame, dims: dict[str, Column], weight: Column, tie: Column, id_col: str = "doc_id", target_bytes: int | None = None, shards: int | None = None) -> DataFrame:
    """docs with shard and slot. dims: name to a non-negative number. Leaves stop at target_bytes, or there are ``shards`` leaves."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    base = docs.select(*keep, weight.cast("long").alias("__w"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"__d_{n}") for n, c in dims.items()), F.xxhash64(tie).alias("__t"), F.xxhash64(F.col(id_col).cast("string")).alias("__i"))
    base = _of_groups(cut(base), list(dims))
    ends = base.agg(F.sum("__w").alias("w"), *(f(f"__d_{n}").alias(f"{g}_{n}") for n in dims for g, f in (("lo", F.min), ("hi", F.max)))).first()
    if ends["w"] is None:
        return base.select(*keep, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = shards or max(1, ceil(ends["w"] / target_bytes))
    span = {n: (ends[f"hi_{n}"] - ends[f"lo_{n}"]) or 1.0 for n in dims}
    low = F.pmod("__t", F.lit(1 << 18)) * (1 << 18) + F.pmod("__i", F.lit(1 << 18))
    rows = base.select("*", *((F.floor((F.col(f"__d_{n}") - ends[f"lo_{n}"]) / span[n] * DIM_MAX).cast("long") * (1 << 36) + low).alias(f"__k_{n}") for n in dims))
    level, done, splits = {1: (0, leaves)}, {}, {}  # node: first leaf and number of leaves; node: leaf; node: dimension and cut
    while True:
        done |= {n: a for n, (a, k) in level.items() if k == 1}
        level = {n: v for n, v in level.items() if v[1] > 1}
        if not level:
            break
        node = _tree(splits)
        here = rows.withColumn("__node", node).where(F.col("__node").isin(list(level)))
        seen = {r["__node"]: r for r in here.groupBy("__node").agg(F.sum("__w").alias("w"), *(f(f"__d_{n}").alias(f"{g}_{n}") for n in dims for g, f in (("lo", F.min), ("hi", F.max)))).collect()}
        done |= {n: a for n, (a, k) in level.items() if n not in seen}
        level = {n: v for n, v in level.items() if n in seen}
        if not level:
            break
        widest = {n: max(dims, key=lambda d, n=n: (seen[n][f"hi_{d}"] - seen[n][f"lo_{d}"]) / span[d]) for n in level}
        cuts = _medians(rows, node, {n: seen[n]["w"] * (k // 2) / k for n, (_, k) in level.items()}, widest, SLACK * ends["w"] / leaves)
        splits |= {n: (widest[n], cuts[n]) for n in level}
        level = {m: v for n, (a, k) in level.items() for m, v in ((2 * n, (a, k // 2)), (2 * n + 1, (a + k // 2, k - k // 2)))}
    placed = cut(rows.select(*keep, _tree(splits, done).cast("int").alias("shard"), "__i"))
    return with_slots(placed, "shard", F.col("__i"), [id_col]).select(*keep, "shard", "slot")


def with_slots(rows: DataFrame, group: str, spread: Column, order: list[str]) -> DataFrame:
    """rows with slot, gapless from 0 in each group; ranks are taken in buckets of about the root of the group's rows."""
    n = rows.groupBy(group).count()
    wide = rows.join(F.broadcast(n), group).withColumn("__b", F.pmod(spread, F.ceil(F.col("count") / F.greatest(F.lit(1000.0), F.sqrt("count")))))
    sizes = wide.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = wide.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order)))
    return ranked.join(starts, [group, "__b"]).withColumn("slot", F.col("__start") + F.col("__r") - 1)


SHARDS = 16


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    code = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20))
    sized = docs.select("doc_id", (utf8_bytes() + 1).alias("size"), F.crc32(text_or_empty().cast("binary")).alias("text_crc32"), "lang", "source", "n_chars")
    dims = {"n_chars": F.log1p(F.greatest("n_chars", F.lit(0))), "lang": code("lang"), "source": code("source")}
    out = kd_shards(sized, dims, F.col("size"), F.struct("text_crc32", "size"), shards=SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
