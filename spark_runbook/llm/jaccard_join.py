"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles have one global order, rare ones first (a bounded sketch of all documents' counts, then the hash). With a threshold t, the l-prefix
of a set of n shingles has n - ceil(t n) + l of them, and two sets that link share at least min(l, l') shingles of their prefixes. Each
document picks l by the candidates that its shortest prefix is estimated to raise, so that documents of frequent shingles get longer
prefixes and must share more of them before a pair is verified.

Documents of the same set are one node. Prefix shingles that no other node has are dropped first (``_repeated``): they are dealt by shingle once, packed,
over a number of parts that follows the input, so what a shingle costs doesn't grow with the corpus. Then:

1. In every list of nodes with a shingle, the others are compared with one node, the one with the most company: a number of pairs
   linear in the prefixes. Linked nodes are joined to components.
2. Lists that still mix components: where up to ``SMALL`` nodes are outside the list's main component, these are verified against the nodes of other
   components, under the positional bound (what is left behind the shared shingle must reach the overlap that the threshold asks for).
3. Of longer lists only nodes stay that are in as many of them as a link must share (``_enough``): whoever shares that many prefix shingles and isn't found in a
   shorter list has all of them there. Most nodes of such lists have one frequent shingle, are far from each other, and go.
4. What stays goes by differences (``_by_differences``): what two sets have in common is known from their differences to the list's hub, which are
   short, so these are joined by prefixes again, in lists that get shorter in each round. Texts of one template that lie just under the
   threshold are thus told apart without comparing each with each.

Every pair that could link is thus verified or already connected; no node is compared with more than ``SMALL`` others of a list. Verification counts
the shared prefix shingles first, then the shared shingles.

Defined results: words are runs of what isn't white space, A-Z as a-z; fewer words than a shingle has are one shingle; null, empty and wordless texts have no
shingles and link with nothing; rows of equal texts are in one component; null ids count as largest; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import LOG2_BITS, maybe_repeated, repeated_filter
from .common import cut, give_back, heavy_keys, renamed, small_batches, spread_join, text_or_empty
from .components import components
from .shingles import chunks, frequency_levels, in_order, mix, shingle_sets

BROADCAST_KEYS = 500_000
SHINGLES_A_MATCH = 50
SMALL = 32
#: Prefix shingles in a part of those dealt by ``_repeated``, and rows that a task gives back at a time.
PART, ROWS = 250_000, 50_000


def prefix_size(n: int, percent: int, l: int) -> int:  # noqa: E741
    return min(n, n - -(-percent * n // 100) + l)


def matches_for(levels: np.ndarray, n: int, percent: int) -> int:
    """l of a set whose ordered shingles have these levels. A candidate costs a comparison of n shingles, and frequent prefix shingles raise more of them: one
    more match for every ``SHINGLES_A_MATCH``, and one each time the estimated candidates double; never more than a link is sure to share."""
    often = np.exp2(levels[: prefix_size(n, percent, 1)] / 4.0) - 1
    return min(-(-percent * n // 100), 1 + n // SHINGLES_A_MATCH + int(np.log2(1 + often.sum() / max(1, len(often)))))


@give_back
def _prefixes(batches, q: int, percent: int, levels):
    for b in batches:
        for first, texts in chunks(b.column(2)):
            rows = []
            for s in shingle_sets(texts, q):
                if not len(s):
                    rows.append((None, None, 0, 0, []))
                    continue
                o, lv = in_order(s, levels.value)
                m = matches_for(lv, len(s), percent)
                with np.errstate(over="ignore"):
                    key = [int(mix(s, k).sum(dtype=np.uint64).view(np.int64)) for k in (11, 12)]
                rows.append((*key, len(s), m, o[: prefix_size(len(s), percent, m)].view(np.int64)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(first, len(rows)), b.column(1).slice(first, len(rows)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.list_(pa.int64()))],
                names=["doc_id", "th", "s1", "s2", "n", "l", "prefix"],
            )


@give_back
def _dealt(batches, parts: int):
    """The prefix shingles of each batch of nodes (nid, n, l, prefix) by part: h as it is, and packed how often the batch has it (2: more than once), nid (as differences), n, l and the place k.
    A batch deals a shingle by its hash once; its other nodes with that shingle are known to have company and are dealt evenly, so a frequent one doesn't fill a part."""
    for b in batches:
        lists = b.column(3)
        size = np.diff(lists.offsets.to_numpy())
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(h):
            continue
        at = np.repeat(np.arange(b.num_rows), size)
        k = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        nid, n, l = (b.column(i).to_numpy(zero_copy_only=False)[at] for i in range(3))  # noqa: E741
        _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        part = np.arange(len(h)) % parts
        part[first] = (mix(h[first], 21) % np.uint64(parts)).astype(np.int64)
        often = np.minimum(count, 2)[inverse].astype(np.uint8)
        order = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.diff(part[order], append=-1)) + 1
        runs = [order[a:z] for a, z in zip([0, *ends], ends, strict=False)]
        packed = [zlib.compress(b"".join(x.tobytes() for x in (often[o], np.diff(nid[o], prepend=0), n[o].astype(np.int32), l[o].astype(np.int32), k[o].astype(np.int32))), 1) for o in runs]
        yield pa.RecordBatch.from_arrays([pa.array([part[o[0]] for o in runs], pa.int32()), pa.array([h[o].tobytes() for o in runs], pa.binary()), pa.array(packed, pa.binary())], names=["part", "h", "rest"])


@give_back
def _company(batches):
    """Of the parts of ``_dealt`` that a task reads: the entries (nid, n, l, k, h) whose shingle several nodes have."""
    hs, rest = [], [[] for _ in range(5)]
    for b in batches:
        for x, y in zip(b.column(1), b.column(2), strict=True):
            hs.append(np.frombuffer(x.as_buffer(), np.uint64))
            data, m, start = zlib.decompress(y.as_buffer()), len(hs[-1]), 0
            for i, kind in enumerate((np.uint8, np.int64, np.int32, np.int32, np.int32)):
                rest[i].append(np.frombuffer(data, kind, m, start))
                start += m * np.dtype(kind).itemsize
            rest[1][-1] = np.cumsum(rest[1][-1])
    if not hs:
        return
    h = np.concatenate(hs)
    often, nid, n, l, k = (np.concatenate(x) for x in rest)  # noqa: E741
    del hs, rest
    order = np.argsort(h, kind="stable")
    starts = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
    total = np.add.reduceat(often[order].astype(np.int64), starts)
    stay = order[np.repeat(total > 1, np.diff(starts, append=len(h)))]
    for i in range(0, len(stay), ROWS):
        o = stay[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(nid[o]), pa.array(n[o]), pa.array(l[o]), pa.array(k[o]), pa.array(h[o].view(np.int64))], names=["nid", "n", "l", "k", "h"])


def _repeated(nodes: DataFrame, total: int) -> DataFrame:
    """nodes: nid, n, l, prefix (``total`` shingles in all). Returns the entries nid, n, l, k, h of the shingles that several nodes have, k being the place in the prefix."""
    parts = 1 + total // PART
    dealt = nodes.select("nid", "n", "l", "prefix").mapInArrow(lambda it: _dealt(it, parts), "part int, h binary, rest binary")
    return cut(dealt.repartition(parts, "part").mapInArrow(_company, "nid long, n int, l int, k int, h long"))


def need(nx: Column, ny: Column, percent: int) -> Column:
    """Shared shingles that sets of these sizes must have."""
    return F.ceil(percent * (nx + ny) / F.lit(100.0 + percent) - 1e-9)


def _maybe_in(keys: DataFrame):
    """A filter on hashes that lets those of keys (th) pass, and few others: a key list too long to broadcast is joined to these rows only, so that no other text shuffles."""
    th = keys.select("th")
    bits = repeated_filter(th.unionByName(th))  # each twice, so all are in it

    @F.pandas_udf("boolean")
    def known(h):
        import pandas as pd

        return pd.Series(maybe_repeated(h.to_numpy(np.int64).view(np.uint64), bits.value, LOG2_BITS))

    return known


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, q: int) -> DataFrame:
    """nid and all its shingles (binary), of the wanted nodes, from their texts."""
    keys = cut(nodes.join(wanted, "nid").select("nid", "doc_id", "th"))
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    else:
        docs = docs.where(_maybe_in(keys)("th"))
    k = keys.select("nid", F.col("doc_id").alias("kd"), F.col("th").alias("kt"))

    @give_back
    def run(batches):
        for b in batches:
            for first, texts in chunks(b.column(1)):
                sets = [s.tobytes() for s in shingle_sets(texts, q)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["nid", "s"])

    return docs.join(k, F.col("doc_id").eqNullSafe(F.col("kd")) & (F.col("th") == F.col("kt"))).select("nid", "text").mapInArrow(run, "nid long, s binary")


def _arrays(sets: DataFrame) -> DataFrame:
    """nid and all its shingles as an array, of what ``_sets`` gives."""

    @give_back
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 100):
                part = b.slice(i, 100)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(v.as_buffer(), np.int64) for v in part.column(1)], pa.list_(pa.int64()))], names=["nid", "d"])

    return cut(sets.mapInArrow(run, "nid long, d array<long>"))


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, common: DataFrame, q: int, percent: int) -> DataFrame:
    """The pairs (a, b, la, lb) that link: those that share enough prefix shingles, then those that share enough of all. common: nid and hs, the prefix shingles that other nodes have as well."""
    pa_, pb = (common.select(F.col("nid").alias(c), F.col("hs").alias(f"p{c}")) for c in "ab")
    pairs = cut(pairs.join(pb, "b").join(pa_, "a").where(F.size(F.array_intersect("pa", "pb")) >= F.least("la", "lb")).select("a", "b", "la", "lb"))
    s = cut(_sets(docs, nodes, pairs.select(F.col("a").alias("nid")).union(pairs.select("b")).distinct(), q))

    @give_back
    def check(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                n = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * n >= percent * (len(x) + len(y) - n):
                    keep.append(i)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    heavy = heavy_keys(pairs.groupBy("a").count(), "a", "count")
    both = spread_join(pairs.join(s.select(F.col("nid").alias("b"), F.col("s").alias("sb")), "b"), s.select(F.col("nid").alias("a"), F.col("s").alias("sa")), "a", heavy, F.col("b"))
    return cut(both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"))


def allowed(nx: Column, ny: Column, percent: int) -> Column:
    """Shingles that may be in one of two linked sets alone."""
    return nx + ny - 2 * need(nx, ny, percent)


def _apart(x: str, y: str) -> Column:
    """What is in one of two arrays alone."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def _mixed(entries: DataFrame, key: str) -> DataFrame:
    """Lists of several components: key, m (nodes), main (the component with most of them), rest (nodes outside it)."""
    per = entries.groupBy(key, "root").agg(F.count("*").alias("x")).groupBy(key).agg(F.sum("x").alias("m"), F.max(F.struct("x", "root")).alias("top"))
    return cut(per.select(key, "m", F.col("top.root").alias("main"), (F.col("m") - F.col("top.x")).alias("rest")).where("rest > 0"))


def _across(entries: DataFrame, key: str, heavy: list, cols: list[str]) -> DataFrame:
    """Pairs of nodes of different components, one of them outside the main one, in lists with at most SMALL of these. cols: of the second, with a 2 behind."""
    few = entries.where(F.col("rest") <= SMALL)
    other = few.where(F.col("root") != F.col("main")).select(key, *(F.col(c).alias(f"{c}2") for c in cols))
    return spread_join(few, other, key, heavy, F.col("nid")).where((F.col("root") != F.col("root2")) & ((F.col("root") == F.col("main")) | (F.col("nid") < F.col("nid2"))))


def _enough(entries: DataFrame, percent: int) -> DataFrame:
    """Of entries in lists too long for pairs, those of nodes that are in as many of these lists as a link must share: min(l, l'), and a linked set has percent of the node's shingles at least.
    A node in fewer of them shares a shorter list with each set it links with."""
    other = F.floor(F.col("n") * percent / 100)
    asked = F.least(F.col("l").cast("long"), F.floor(other * percent / 100), 1 + F.floor(other / SHINGLES_A_MATCH))
    stay = entries.groupBy("nid").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("l").alias("l")).where(F.col("c") >= asked).select("nid")
    return cut(entries.join(stay, "nid"))


def _rebased(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (g, nid, base, hub) with the differences to their group's hub, from those to an older base that known has (base, nid, n, root, d)."""
    of = lambda who, to: known.select("base", F.col("nid").alias(who), F.col("n").alias(to[0]), F.col("root").alias(to[1]), F.col("d").alias(to[2]))
    sizes = cut(members.groupBy("g", "base", "hub").count())
    hubs = sizes.join(of("hub", ("hn", "hroot", "hd")), ["base", "hub"]).select("g", "hn", "hroot", "hd")
    own = members.join(of("nid", ("n", "root", "d")), ["base", "nid"]).select("g", "nid", "hub", "n", "root", "d")
    out = spread_join(own, hubs, "g", heavy_keys(sizes, "g", "count"), F.col("nid"))
    return cut(out.select("g", "nid", "hub", "n", "hn", "root", "hroot", _apart("d", "hd").alias("d")))


def _by_differences(groups: DataFrame, sets: DataFrame, percent: int, counts: list | None = None) -> DataFrame | None:
    """Links (a, b) among the nodes of each group. groups: hub, nid, root (the component so far); sets: nid, d (all shingles), for hubs as well.

    With D(x) what is in x or in the hub alone, D(x) and D(y) differ just where x and y do. If x isn't linked with the hub, D(x) and D(y)
    of a linked pair share a shingle, and (|D(x)| + |D(y)| - allowed) / 2 at least: the prefix filter again, on short sets, ordered by how
    rare a shingle is in the group. Lists are kept apart by the sizes of both sides, as the share asked for depends on these. Lists with few nodes outside their main component
    are verified as above; others get a hub of their own and go to the next round, without this one's hub, so that rounds end.
    """
    found = None
    known = sets.select(F.lit("").alias("base"), "nid", F.size("d").cast("long").alias("n"), "d")
    known = known.join(groups.select("nid", "root").distinct(), "nid")
    members = groups.select(F.col("hub").cast("string").alias("g"), "nid", F.lit("").alias("base"), "hub")
    while True:
        state = _rebased(members, known)
        state = state.withColumn("linked", F.size("d") <= allowed(F.col("n"), F.col("hn"), percent))
        new = state.where(F.col("linked") & (F.col("nid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("nid").alias("b"))
        found = new if found is None else found.unionByName(new)
        step = F.greatest(F.lit(1), F.floor(F.col("hn") * ((100 - percent) / (4.0 * percent)))).cast("int")
        at = state.where(F.col("nid") != F.col("hub")).select("g", "nid", "n", F.when(F.col("linked"), F.col("hroot")).otherwise(F.col("root")).alias("root"), F.col("hub").alias("was"), "d", step.alias("w"), F.size("d").alias("e"), F.floor(F.col("n") * ((100 - percent) / percent) + 1e-9).cast("int").alias("most"))
        state = cut(at.withColumn("c", F.floor(F.col("e") / F.col("w")).cast("int")))
        if counts is not None:
            counts.append(("differences", state.count()))
        token = state.select("g", "nid", F.explode("d").alias("t")).withColumn("gt", F.concat_ws(" ", "g", "t"))
        rare = cut(token.groupBy("gt").agg(F.count("*").alias("f")).where("f > 1"))  # a shingle of one node finds none
        shared = spread_join(token, rare, "gt", heavy_keys(rare, "gt", "f"), F.col("nid"))
        order = shared.groupBy("g", "nid").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("o"))  # a node's own shingles
        kinds = state.groupBy("g").agg(F.collect_set("c").alias("kinds"))
        # shingles that one node alone has come first in the order and take up the prefix
        ask = lambda k: F.greatest(F.lit(1), F.ceil((F.col("e") + k * F.col("w") - F.col("most")) / F.lit(2.0))).cast("int")
        near = F.filter("kinds", lambda k: (k * F.col("w") <= F.col("e") + F.col("most")) & ((k + 1) * F.col("w") > F.col("e") - F.col("most")))
        by = state.drop("d").join(order, ["g", "nid"]).join(kinds, "g").withColumn("k", F.explode(near))
        by = by.withColumn("p", F.size("o") - ask(F.col("k")) + 1).where("p > 0").withColumn("t", F.explode(F.slice("o", F.lit(1), F.col("p"))))
        entry = cut(by.select(F.concat_ws(" ", "g", F.least("c", "k"), F.greatest("c", "k"), F.col("t")["t"]).alias("key"), "g", "nid", "root", "c", "k"))
        # lists that hold several components, and both of their kinds
        whole = entry.groupBy("key").agg(((F.min("c") < F.max("c")) | (F.min("c") == F.min("k"))).alias("whole")).where("whole").select("key")
        lists = cut(_mixed(entry, "key").join(whole, "key"))
        heavy = heavy_keys(lists, "key", "m")
        entry = cut(spread_join(entry, lists, "key", heavy, F.col("nid")))
        pairs = _across(entry, "key", heavy, ["nid", "root", "c"]).where((F.col("k") == F.col("c2")) | (F.col("k") == F.col("c")))
        pairs = cut(pairs.select("g", F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")).distinct())
        if counts is not None:
            counts.append(("pairs", pairs.count()))
        side = lambda x: state.select("g", F.col("nid").alias(x), F.col("n").alias(f"n{x}"), F.col("d").alias(f"d{x}"))
        both = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
        found = cut(found.unionByName(both.where(F.size(_apart("da", "db")) <= allowed(F.col("na"), F.col("nb"), percent)).select("a", "b")))
        many = entry.where(F.col("rest") > SMALL)
        if many.isEmpty():
            return found
        score = many.groupBy("g", "nid").agg(F.count("*").alias("s"))
        best = cut(many.join(score, ["g", "nid"]).groupBy("key").agg(F.max(F.struct("s", F.negative("nid").alias("less"))).alias("b")).select("key", F.negative("b.less").alias("hub")))
        members = spread_join(many.select("key", "g", "nid"), best, "key", heavy, F.col("nid")).select(F.concat_ws("/", "g", "hub").alias("g"), "nid", F.col("g").alias("base"), "hub").distinct()
        known = state.select(F.col("g").alias("base"), "nid", "n", "root", "d")


def jaccard_components(docs: DataFrame, q: int, percent: int, id_col: str = "doc_id", text_col: str = "text", counts: list | None = None) -> DataFrame:
    """One row a row of docs: doc_id, th (hash of the text), n_shingles, component_id (smallest id reachable), keep (one row's id and text of each component). counts, if given, gets how much was compared in each step."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("th"), text_or_empty(text_col).alias("text"))
    levels = frequency_levels(plain.select("text"), q)
    every = plain.mapInArrow(lambda it: _prefixes(it, q, percent, levels), "doc_id long, th long, s1 long, s2 long, n int, l int, prefix array<long>")
    every = cut(every.withColumn("nid", F.monotonically_increasing_id()))
    classes = every.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "th", "l", "nid")).alias("r"))
    nodes = cut(classes.select("s1", "s2", "n", "r.*"))
    copies = cut(every.where("n > 0").select("nid").join(nodes, "nid", "left_anti"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies
    total = nodes.agg(F.sum(F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * (percent / 100)) + F.col("l")))).first()[0]
    entries = _repeated(every.where("n > 0").join(copies, "nid", "left_anti"), total or 0)
    common = cut(entries.groupBy("nid").agg(F.collect_list("h").alias("hs")))
    sizes = cut(entries.groupBy("h").agg(F.count("*").alias("m")))
    often = heavy_keys(sizes, "h", "m")
    entries = cut(spread_join(entries, sizes, "h", often, F.col("nid")))
    score = entries.groupBy("nid").agg(F.sum("m").alias("score"))
    hubs = cut(entries.join(score, "nid").groupBy("h").agg(F.max(F.struct("score", F.negative("nid").alias("less"), "nid", "n", "k", "l")).alias("hub")).select("h", "hub.*").select("h", F.col("nid").alias("hub"), F.col("n").alias("hn"), F.col("k").alias("hk"), F.col("l").alias("hl")))
    fits = lambda na, ka, nb, kb: F.least(F.col(na) - F.col(ka), F.col(nb) - F.col(kb)) >= need(F.col(na), F.col(nb), percent)
    star = spread_join(entries, hubs, "h", often, F.col("nid")).where((F.col("nid") != F.col("hub")) & fits("n", "k", "hn", "hk"))
    star = cut(star.select(F.col("hub").alias("a"), F.col("nid").alias("b"), F.col("hl").alias("la"), F.col("l").alias("lb")).distinct())
    links = _verified(star, plain, nodes, common, q, percent)
    comp = components(links)
    if counts is not None:
        counts.append(("hubs", star.count()))

    rooted = cut(entries.join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")))
    live = cut(spread_join(rooted.drop("m"), _mixed(rooted, "h"), "h", often, F.col("nid")))
    # what is shared in front of the places counts as well, so that a pair is found in any of its lists
    reach = F.least("k", "k2") + F.least(F.col("n") - F.col("k"), F.col("n2") - F.col("k2")) >= need(F.col("n"), F.col("n2"), percent)
    first = F.col("nid") < F.col("nid2")

    def short(lists: DataFrame) -> DataFrame:
        two = _across(lists, "h", often, ["nid", "n", "k", "l", "root"]).where(reach)
        return two.select(F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b"), F.when(first, F.col("l")).otherwise(F.col("l2")).alias("la"), F.when(first, F.col("l2")).otherwise(F.col("l")).alias("lb"))

    many = _enough(live.where(F.col("rest") > SMALL).drop("main", "rest"), percent)
    again = cut(spread_join(many, _mixed(many, "h").drop("m"), "h", often, F.col("nid")))  # lists are shorter now
    many = _enough(again.where(F.col("rest") > SMALL), percent)
    pairs = cut(short(live).unionByName(short(again)).distinct())
    if counts is not None:
        counts.append(("pairs", pairs.count()))
    more = _verified(pairs, plain, nodes, common, q, percent)
    if not many.isEmpty():
        score = many.groupBy("nid").agg(F.count("*").alias("score"))
        best = cut(many.join(score, "nid").groupBy("h").agg(F.max(F.struct("score", F.negative("nid").alias("less"))).alias("b")).select("h", F.negative("b.less").alias("hub")))
        groups = cut(spread_join(many.select("h", "nid", "root"), best, "h", often, F.col("nid")).select("hub", "nid", "root").distinct())
        more = more.unionByName(_by_differences(groups, _arrays(cut(_sets(plain, nodes, groups.select("nid").distinct(), q))), percent, counts))
    comp = components(links.unionByName(more)) if not more.isEmpty() else comp

    rooted = cut(nodes.join(comp.withColumnRenamed("node", "nid"), "nid", "left").withColumn("root", F.coalesce("root", "nid")))
    smallest = cut(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"), F.count("*").alias("m")))
    named = cut(spread_join(rooted.select("root", "s1", "s2", "n"), smallest, "root", heavy_keys(smallest, "root", "m"), F.col("s1")).select("s1", "s2", "n", F.col("r.doc_id").alias("component_id"), F.col("r.th").alias("rt")))
    linked = every.where("n > 0").select("doc_id", "th", "s1", "s2", "n").join(named, ["s1", "s2", "n"])
    linked = linked.select("doc_id", "th", F.col("n").cast("long").alias("n_shingles"), "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("rt"))).alias("keep"))
    return linked.unionByName(every.where("n = 0").select("doc_id", "th", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("keep")))


def drop_near(docs: DataFrame, q: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component; same columns, whatever their names. Rows of equal id and text stay or go together."""
    plain, (i, t), restore = renamed(docs, id_col, text_col)
    gone = cut(jaccard_components(plain, q, percent, i, t).where(~F.col("keep")).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct())
    same = F.col(i).eqNullSafe(F.col("__d")) & (F.xxhash64(text_or_empty(t)) == F.col("__t"))
    if gone.count() <= BROADCAST_KEYS:
        return restore(plain.join(F.broadcast(gone), same, "left_anti"))
    maybe = _maybe_in(gone.select(F.col("__t").alias("th")))(F.xxhash64(text_or_empty(t)))
    return restore(plain.where(~maybe).unionByName(plain.where(maybe).join(gone, same, "left_anti")))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id")
