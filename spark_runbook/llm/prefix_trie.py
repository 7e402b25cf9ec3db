"""Prefix trie of conversations that are rebuilt from the head of another one and their own tail, by composable fingerprints.

A sequence of turns has the fingerprint (n, v), v the sum of turn j's digest times B ** j modulo a prime, for two primes. These form a monoid: (n, v) before
(m, w) is (n + m, v + B ** n * w). So prefixes of all conversations are one scan over ranges of the sorted turns, with what came before a
range composed in front (``prefix_products``), and the prefixes of a rebuilt conversation follow from those of its base's head and of its own turns alone:
v(head) + B ** (len(head) - h) * (v(own first i) - v(own first h)). No rebuilt text or list of turns is ever made; a member of a node is a row of numbers with a reference to a
stored turn (its conversation and place) and that turn's SHA-256.

A node is a depth and a fingerprint. Groups are verified: all members of a node must refer to turns of one digest and have one parent fingerprint, so
by induction they are equal turn by turn. If a group fails, B is drawn anew.

Sums over subtrees need no walk by levels. Of the members of a node the smallest stands for it, and stands for all nodes from there
on down its own path. So each node's weight counts once, for the conversation that stands for it, and a node's subtree sum is the sum of its members' weights
less the part that the standing conversation has above the node: one grouped sum over members and one running sum.

No step gathers a conversation, a node's members or a level: running sums go by ranges with a carry, large conversations and nodes with many children are dealt over
many tasks in joins. The digest of a node's ends is a SHA-256 over one text by contract, so it is sequential: ids are joined to texts of ``CHUNK`` ids where they lie,
and one task reads these texts of a node in order with constant memory.

Defined results: turns go by turn (null first), then role, then text; null role or text is empty; repeated rows are turns of their own; rows with a null conv_id
belong to no conversation and are left out; an absent base gives an empty head, a short one what it has; an empty table gives an empty result; turns may be of any length and conversations of any number of turns;
other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, heavy_keys, spread_join

HEADS, SPAN, CHUNK = 5, 100, 500
MODULI = (2**31 - 1, 2**31 - 19)  # primes: products of residues stay below 2**62, and a pair of them fits in a long
AB = ("a", "b")


def drawn_bases() -> Iterator[tuple[int, int]]:
    for seed in count():
        d = hashlib.sha256(str(seed).encode()).digest()
        yield tuple(2 + int.from_bytes(d[8 * i : 8 * i + 8], "big") % (m - 2) for i, m in enumerate(MODULI))


def _mod(c: Column, m: int) -> Column:
    return F.pmod(c, F.lit(m).cast("long"))


def _power(n: Column, base: int, m: int, bits: int = 40) -> Column:
    """base ** n modulo m, by the bits of n."""
    factors = (F.when(n.cast("long").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(pow(base, 1 << i, m)).cast("long")).otherwise(F.lit(1).cast("long")) for i in range(bits))
    return reduce(lambda acc, f: _mod(acc * f, m), factors)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, part, digest, len of all turns: pos rises with conversation and place, part is the range it lies in."""
    none = F.lit("")
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    t = t.repartitionByRange(_parts(t), "conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    content = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    t = t.select("conv_id", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part"), F.sha2(content, 256).alias("digest"), F.length("text").cast("long").alias("len"))
    return cut(t)


def prefix_products(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """turns with i (place in its conversation, from 1), a and b (fingerprint of the first i turns by each prime), ta and tb (the turn's own summand)."""
    at = lambda k: F.conv(F.substring("digest", 1 + 15 * k, 15), 16, 10).cast("long")
    inside = Window.partitionBy("part", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.withColumn("i", F.row_number().over(inside).cast("long"))
    own = own.withColumns({f"t{x}": _mod(_mod(at(k), m) * _power(F.col("i"), bases[k], m), m) for k, (x, m) in enumerate(zip(AB, MODULI, strict=True))})
    own = cut(own.withColumns({x: _mod(F.sum(f"t{x}").over(inside), m) for x, m in zip(AB, MODULI, strict=True)}).drop("pos"))
    whole = own.groupBy("conv_id", "part").agg(F.max("i").alias("n"), *(F.max_by(x, "i").alias(x) for x in AB))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("n0", F.sum("n").over(earlier))
    moved = whole.withColumns({f"s{x}": _mod(F.col(x) * _power(F.coalesce("n0", F.lit(0)), bases[k], m), m) for k, (x, m) in enumerate(zip(AB, MODULI, strict=True))})
    carry = moved.withColumns({f"c{x}": _mod(F.sum(f"s{x}").over(earlier), m) for x, m in zip(AB, MODULI, strict=True)}).where("n0 > 0")
    carry = carry.select("conv_id", "part", "n0", "ca", "cb", *(_power(F.col("n0"), bases[k], m).alias(f"p{x}") for k, (x, m) in enumerate(zip(AB, MODULI, strict=True))))
    all_ = own.join(F.broadcast(carry), ["conv_id", "part"], "left")  # a range begins inside at most one conversation, so carry has a row a range at most
    shifted = lambda c, x, m: F.when(F.col("n0").isNull(), F.col(c)).otherwise(_mod(F.col(c) * F.col(f"p{x}"), m))
    return all_.select(
        "conv_id", "digest", "len", (F.col("i") + F.coalesce("n0", F.lit(0))).alias("i"),
        *(_mod(F.coalesce(F.col(f"c{x}"), F.lit(0)) + shifted(x, x, m), m).alias(x) for x, m in zip(AB, MODULI, strict=True)), *(shifted(f"t{x}", x, m).alias(f"t{x}") for x, m in zip(AB, MODULI, strict=True)),
    )


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a, 31) + b


def default_plan(convs: DataFrame) -> DataFrame:
    """conv_id, base_id and h (how many turns of the base come first, and how many of its own go): the contract's rule."""
    c = F.col("conv_id")
    return convs.select("conv_id", (c - c % SPAN).alias("base_id"), (F.crc32(c.cast("string").cast("binary")) % (HEADS + 1)).cast("int").alias("h"))


def members(turns: DataFrame, plan, bases: tuple[int, int]) -> DataFrame:
    """A row for each rebuilt conversation c and depth d: f and pf (fingerprints of the first d and d - 1 turns), len, digest and reference (conversation, place) of the last turn, last: whether c ends there."""
    products = prefix_products(turns, bases)
    place = F.when(F.col("i") <= HEADS, F.struct("i", "a", "b", "ta", "tb", "len", "digest"))
    convs = cut(products.groupBy("conv_id").agg(F.max("i").alias("n"), F.array_sort(F.collect_list(place)).alias("heads")))
    rules = plan(convs)
    base = convs.select(F.col("conv_id").alias("base_id"), F.col("heads").alias("base_heads"))
    zero = F.lit(0).cast("long")
    at = lambda arr, k, x: F.coalesce(F.get(arr, k - 1)[x], zero)
    j = convs.join(rules, "conv_id").join(base, "base_id", "left").withColumn("bh", F.coalesce(F.slice("base_heads", F.lit(1), F.col("h")), F.array().cast(dict(convs.dtypes)["heads"])))
    j = j.withColumn("h0", F.size("bh"))
    info = cut(j.select("conv_id", "base_id", "h", "h0", "bh", (F.col("h0") + F.greatest(zero, F.col("n") - F.col("h"))).alias("total"), "n", *(at("bh", F.col("h0"), x).alias(f"head_{x}") for x in AB), *(at("heads", F.col("h"), x).alias(f"own_{x}") for x in AB)))
    heavy = heavy_keys(info, "conv_id", "n")
    own = spread_join(products, info.drop("bh", "n"), "conv_id", heavy, F.col("i")).where("i > h")
    # the shift h0 - h lies between -HEADS and 0
    back = [F.array(*(F.lit(pow(b, -k, m) if b else 0).cast("long") for k in range(HEADS + 1))) for b, m in zip(bases, MODULI, strict=True)]
    inv = dict(zip(AB, (F.get(x, F.col("h") - F.col("h0")) for x in back), strict=True))
    own = own.withColumns({f"f{x}": _mod(F.col(f"head_{x}") + _mod(F.col(x) - F.col(f"own_{x}"), m) * inv[x], m) for x, m in zip(AB, MODULI, strict=True)})
    own = own.withColumns({f"p{x}": _mod(F.col(f"f{x}") - F.col(f"t{x}") * inv[x], m) for x, m in zip(AB, MODULI, strict=True)})
    depth = F.col("h0") + F.col("i") - F.col("h")
    ref = lambda c, i: F.struct(F.col(c).alias("conv_id"), F.col(i).alias("place"))
    tail = own.select(F.col("conv_id").alias("c"), depth.alias("d"), _pair(F.col("fa"), F.col("fb")).alias("f"), _pair(F.col("pa"), F.col("pb")).alias("pf"), "len", "digest", ref("conv_id", "i").alias("ref"), (depth == F.col("total")).alias("last"))
    head = info.select("conv_id", "base_id", "total", F.explode("bh").alias("x")).select("conv_id", "base_id", "total", "x.*")
    before = lambda x, m: _mod(F.col(x) - F.col(f"t{x}"), m)
    head = head.select(F.col("conv_id").alias("c"), F.col("i").alias("d"), _pair(F.col("a"), F.col("b")).alias("f"), _pair(before("a", MODULI[0]), before("b", MODULI[1])).alias("pf"), "len", "digest", ref("base_id", "i").alias("ref"), (F.col("i") == F.col("total")).alias("last"))
    null = lambda t: F.lit(None).cast(t)
    root = info.select(F.col("conv_id").alias("c"), zero.alias("d"), zero.alias("f"), null("long").alias("pf"), zero.alias("len"), null("string").alias("digest"), null("struct<conv_id:long,place:long>").alias("ref"), (F.col("total") == 0).alias("last"))
    return cut(tail.unionByName(head).unionByName(root))


def _grouped(m: DataFrame) -> DataFrame:
    same = F.coalesce((F.min("digest") == F.max("digest")) & (F.min("pf") == F.max("pf")), F.lit(True))
    return cut(m.groupBy("d", "f").agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("pf").alias("pf"), F.max("len").alias("len"), F.min("ref").alias("ref"), same.alias("same")))


def running_sum(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """df with ``sum``: value added up in order within each key, by ranges with a carry; (key, order) is unique."""
    dealt = cut(df.repartitionByRange(_parts(df), key, order).withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = dealt.groupBy(key, "part").agg(F.sum(value).alias("s")).withColumn("carry", F.sum("s").over(earlier)).where("carry IS NOT NULL").select(key, "part", "carry")
    inside = F.sum(value).over(Window.partitionBy("part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("sum", inside).join(F.broadcast(carry), [key, "part"], "left").withColumn("sum", F.col("sum") + F.coalesce("carry", F.lit(0))).drop("part", "carry")  # carry: a row a range at most


def _digests(ends: DataFrame) -> DataFrame:
    """d, f, ends_sha256 of the ids c of each node, ascending and joined by commas."""
    dealt = cut(ends.repartitionByRange(_parts(ends), "f", "d", "c").withColumn("part", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("part", "f", "d").orderBy("c"))
    chunks = dealt.withColumn("chunk", F.floor((rank - 1) / CHUNK)).groupBy("f", "d", "part", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for f, d, ids in zip(*(batch.column(n).to_pylist() for n in ("f", "d", "ids")), strict=True):
                if (d, f) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, f), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(out)
        if node:
            yield _rows([(*node, sha.hexdigest())])

    return chunks.repartition("f", "d").sortWithinPartitions("f", "d", "part", "chunk").select("f", "d", "ids").mapInArrow(digest, "d long, f long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"d": pa.int64(), "f": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def trie(conversations: DataFrame, plan=default_plan, bases: Iterable[tuple[int, int]] | None = None) -> DataFrame:
    """A row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn (reference to a stored turn: conversation and place).

    conversations: conv_id, turn, role, text; plan: from a table with conv_id to conv_id, base_id, h (at most ``HEADS``)."""
    turns = stored_turns(conversations)
    for b in bases or drawn_bases():
        m = members(turns, plan, b)
        nodes = _grouped(m)
        if nodes.where(~F.col("same")).isEmpty():
            break
    zero = F.lit(0).cast("long")
    children = cut(nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("pf").alias("f")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, ["d", "f"], "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("w", (F.col("n_convs") - 1) * F.col("len"))
    nodes = cut(nodes.drop("same", "len"))
    parents = nodes.select(F.col("d").alias("pd"), F.col("f").alias("pf"), F.col("conv_id").alias("parent_conv_id"))
    placed = spread_join(nodes, parents, "pf", heavy_keys(children, "f", "n_children"), F.col("f"), "left").where("d = 0 OR pd = d - 1")
    stand = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("w").alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    lengths = m.groupBy("c").agg(F.count("*").alias("n"))
    sums = spread_join(m.select("c", "d", "f"), stand, "c", heavy_keys(lengths, "c", "n"), F.col("d")).groupBy("d", "f")
    sums = sums.agg(F.sum("leaf").alias("n_leaves"), F.sum("total").alias("all"), F.min(F.struct("c", "total"))["total"].alias("standing"))
    below = running_sum(nodes.select("conv_id", "d", "f", "w", (-F.col("d")).alias("up")), "conv_id", "up", "w").select("d", "f", F.col("sum").alias("below"))
    out = placed.join(sums, ["d", "f"]).join(below, ["d", "f"]).join(_digests(m.where("last").select("d", "f", "c")), ["d", "f"], "left")
    return out.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") + F.col("all") - F.col("standing")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.col("ref").alias("turn"),
    )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("turn")


OP13_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY i) AS own, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
steps AS (SELECT *, flatten(list_transform(range(1, length(s) + 1), lambda j: [CAST(ascii(substr(s, j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM o),
c AS (SELECT conv_id, own, xor(list_reduce(list_concat([4294967295], ops), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h FROM steps),
rb AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS s FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS k FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rb)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n) AS ends, (count(*) - 1) * coalesce(length(k[d].x), 0) AS w FROM p GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k, d)),
sub AS (SELECT k[1:e] AS k, e AS d, sum(w) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT k, w, n_children, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN sub ON sub.k = m.k AND sub.d = m.d LEFT JOIN n q ON m.d > 0 AND q.d = m.d - 1 AND q.k = m.k[1:m.d - 1]
"""
