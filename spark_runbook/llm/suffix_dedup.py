"""Removal of long repeated byte strings by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of ``length`` bytes around it also starts earlier. Every such string has an anchor: the least-hashed gram of ``GRAM`` bytes in it,
which all its occurrences share at the same offset. So not all suffixes are sorted but those that start at anchors, each followed by what
stands to its left, read backwards: all strings that an anchor serves can be told equal from what it shares to the right and to the left. Steps:

1. Whole texts that are equal to an earlier one are settled by their hash and leave.
2. A two-bit Bloom filter of fixed size over the anchors' hashes tells which anchors can repeat at all; only their suffixes are sorted.
3. A task sorts its suffixes to a run. Of equal ones it keeps the earliest and marks the others at once, so a passage that stands in a third of
   all documents is sent once a run. The run is cut at sampled splitters and each piece front-coded: for each suffix the length it shares
   with the one before it, and the rest.
4. Pieces of a range meet in one task and are merged by a loser tree that keeps for each run's head the prefix it shares with the last
   suffix put out: heads that share different lengths are ordered by these alone, and others are compared from there on. Which strings are equal
   is read off the same shared prefixes of sorted neighbours (``_settle``).
5. A gram that stands in many different surroundings (a common line, the edge of a common passage) isn't merged in one task: such grams are found in a
   sample of documents, and their strings are sent as hashes of 16 bytes, dealt by hash over all tasks. Which grams these are steers load, not results.
6. Marks are gathered by document and spans cut out of the texts.

Defined results: null counts as empty; matches don't cross documents; documents of equal id are ordered by their text's hash; rows of
equal id and text count as one document and get equal results; null ids come first; an empty table gives an empty result; other
columns aren't read; a long text is worked on in windows of a fixed size.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .bloom import FLUSH, _emit, maybe_repeated, merged_filter
from .common import cut, give_back, heavy_keys, small_batches, spread_join, text_or_empty
from .shingles import _VALUE_ANY_CASE, CHUNK_BYTES, chunks, mix, powers

LENGTH, GRAM = 100, 60
FILTER_BITS = 28
RUN = 200_000
OUTSIDE = 0xFF  # no byte of UTF-8: where a document ends
BROADCAST_KEYS = 500_000
#: A gram with so many different suffixes in one of SAMPLED documents is settled by string; at most BROADCAST_KEYS grams, the most frequent ones.
HOT, SAMPLED = 64, 32
#: Text that a part of the merge serves.
PART_BYTES = 16 << 20
_STRING = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("start", "<u4")])
_U = np.uint64
NULL_ID = -(1 << 63)


def anchored(texts: list[bytes], length: int, gram: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the joined texts: its bytes, where each text starts, all starts of strings of the length that lie in one text (of a single text those
    from lo to hi), and the place and hash of each one's anchor."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = len(data) - gram + 1
    if n < length - gram + 1:
        return data, first, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE_ANY_CASE[data] * p[: len(data)])])
        h = mix((run[gram:] - run[:-gram]) * inverse[:n], 5)
    # the place in the low bits: of equal grams in a string, the first is its anchor
    low = h & ~_U(0xFFFFFFFF) | np.arange(n, dtype=np.uint64)
    w, step = length - gram + 1, 1
    while step * 2 <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < w:
        low = np.minimum(low[: len(low) - (w - step)], low[w - step :])
    starts = np.concatenate([np.arange(a, max(a, z - length + 1)) for a, z in zip(first, first[1:], strict=False)]) if len(texts) > 1 else np.arange(len(low))[lo:hi]
    place = (low[starts] & _U(0xFFFFFFFF)).astype(np.int64)
    return data, first, starts, place, h[place]


def windows(texts: list[bytes], length: int, gram: int):
    """(texts, lo, hi, offset) to be worked on at a time: all of them, or of one long text a window of string starts with its margins."""
    side = length - gram
    if len(texts) > 1 or len(texts[0]) <= 2 * CHUNK_BYTES - 2 * length:
        yield texts, 0, None, 0
        return
    for a in range(0, len(texts[0]) - length + 1, CHUNK_BYTES):
        begin = max(0, a - side)
        yield [texts[0][begin : a + CHUNK_BYTES - 1 + length + side]], a - begin, a - begin + CHUNK_BYTES, begin


def front_code(strings: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted distinct strings (n, length): shared prefix lengths with the one before, and the rests, joined."""
    same = strings[1:] == strings[:-1]
    shared = np.concatenate([[0], np.where(same.all(1), strings.shape[1], same.argmin(1))]).astype(np.uint8)
    return shared, strings[np.arange(strings.shape[1]) >= shared[:, None]].tobytes()


class Run:
    """A front-coded run, read from the front: head, the prefix it shares with the one before it, and whose it is."""

    __slots__ = ("at", "docs", "head", "i", "length", "n", "rest", "shared", "starts")

    def __init__(self, shared: bytes, rest: bytes, docs, starts, length: int):
        self.shared, self.rest, self.docs, self.starts, self.length = shared, rest, docs, starts, length
        self.i, self.at, self.n, self.head = -1, 0, len(shared), b""

    def next(self) -> int:
        """Moves on; the new head's shared prefix with the old one, or -1 at the end."""
        self.i += 1
        if self.i >= self.n:
            return -1
        s = self.shared[self.i]
        z = self.at + self.length - s
        self.head = self.head[:s] + self.rest[self.at : z]
        self.at = z
        return s


def merge_runs(runs: list[Run]):
    """Suffixes of all runs in order: (run, the prefix it shares with the one put out before it).

    A loser tree over the runs. known[r] is the prefix that the head of r shares with the last suffix put out. Of two heads the one
    that shares more comes first, and the other shares with it what it shared with the last; only equal sharers are compared, from
    there on. An ended run loses against all.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    length = runs[0].length if runs else 0
    known = [r.next() for r in runs] + [-1] * (size - k)
    heads = runs
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0 or x == length:
            return (a, b) if a < b else (b, a)
        s, t = heads[a].head, heads[b].head
        u, v = s[x:], t[x:]
        if u == v:
            a, b = (a, b) if a < b else (b, a)
            known[b] = length
            return a, b
        if u > v:
            a, b = b, a
        # shared length of the two, by halving
        lo, hi = x, length
        while hi - lo > 1:
            mid = (lo + hi) >> 1
            if s[lo:mid] == t[lo:mid]:
                lo = mid
            else:
                hi = mid
        known[b] = lo
        return a, b

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, loser = play(build(2 * node), build(2 * node + 1))
        tree[node] = loser
        return w

    w = build(1) if size > 1 else 0
    while known[w] >= 0:
        yield w, known[w]
        known[w] = heads[w].next()
        node = (w + size) >> 1
        while node:
            other = tree[node]
            x, y = known[w], known[other]
            if y > x:
                tree[node], w = w, other
            elif x == y:
                w, tree[node] = play(w, other)
            node >>= 1


_MARKS = "doc_id long, th long, spans binary"
_NAMES = ["part", "run", "piece", "doc_id", "th", "spans"]


def suffixes(texts: list[bytes], bits: np.ndarray, length: int, gram: int):
    """Of the anchors that may repeat: their suffixes (gram, right side, left side backwards), text, place in it, the largest and least offset of
    strings they serve, and the gram's hash; for each window. An anchor on the edge of two windows comes in both, with the offsets of each."""
    for part, lo, hi, offset in windows(texts, length, gram):
        data, begin, starts, place, h = anchored(part, length, gram, lo, hi)
        p, at = np.unique(place, return_index=True)
        last = np.append(at[1:], len(place)) - 1
        again = maybe_repeated(h[at], bits, FILTER_BITS)
        if not again.any():
            continue
        p, far, near = p[again], (p - starts[at])[again], (p - starts[last])[again]
        side = length - gram
        padded = np.concatenate([np.full(side, OUTSIDE, np.uint8), data, np.full(side, OUTSIDE, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, gram + 2 * side)
        doc = np.searchsorted(begin, p, side="right") - 1
        out = np.empty((len(p), gram + 2 * side), np.uint8)
        out[:, : gram + side], out[:, gram + side :] = around[p, side:], around[p, side - 1 :: -1]
        j = np.arange(side)
        out[:, gram : gram + side][j >= (begin[doc + 1] - p - gram)[:, None]] = OUTSIDE
        out[:, gram + side :][j >= (p - begin[doc])[:, None]] = OUTSIDE
        yield out, doc, p - begin[doc] + offset, far, near, h[at][again]


def _runs(batches, bits, hot, splitters: np.ndarray, length: int, gram: int, parts: int):
    """Sorted, front-coded pieces of runs, and marks of what repeats inside a run."""
    held: list[tuple] = []
    count = 0
    task, number = TaskContext.get().partitionId(), 0
    for b in batches:
        ids, ths = ([NULL_ID if v is None else v for v in b.column(i).to_pylist()] for i in (0, 1))
        for first, texts in chunks(b.column(2)):
            for strings, doc, place, far, near, h in suffixes(texts, bits.value, length, gram):
                u, back = np.unique(doc, return_inverse=True)
                held.append((strings, [(ids[d + first], ths[d + first]) for d in u.tolist()], back, place, far, near, np.isin(h, hot.value)))
                count += len(doc)
                if count >= RUN:
                    yield from _run(held, splitters, length, gram, f"{task}-{number}", parts)
                    held, count, number = [], 0, number + 1
    if held:
        yield from _run(held, splitters, length, gram, f"{task}-{number}", parts)


def _run(held, splitters, length, gram, name, parts):
    keys = sorted({k for x in held for k in x[1]})
    index = {k: n for n, k in enumerate(keys)}
    who = np.concatenate([np.array([index[k] for k in x[1]])[x[2]] for x in held])
    strings, place, far, near, hot = (np.concatenate([x[i] for x in held]) for i in (0, 3, 4, 5, 6))
    held.clear()
    o = np.lexsort((place, who))
    o = o[np.argsort(strings.view(f"S{strings.shape[1]}").ravel()[o], kind="stable")]
    strings, who, place, far, near, hot = strings[o], who[o], place[o], far[o], near[o], hot[o]
    fresh = np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)])
    # one anchor of one document, from two windows or two equal rows: one suffix with all its offsets
    one = fresh | np.concatenate([[True], (who[1:] != who[:-1]) | (place[1:] != place[:-1])])
    at = np.flatnonzero(one)
    far, near = np.maximum.reduceat(far, at), np.minimum.reduceat(near, at)
    strings, who, place, hot, fresh = strings[at], who[at], place[at], hot[at], fresh[at]
    lost = ~fresh
    yield from _marks(keys, who[lost], (place - far)[lost], (place - near)[lost] + length, parts)
    common, fresh = fresh & hot, fresh & ~hot
    if common.any():
        yield from _strings(keys, *(x[common] for x in (strings, who, place, far, near)), length, gram, parts)
    strings, who, place, far, near = (x[fresh] for x in (strings, who, place, far, near))
    if not len(strings):
        return
    width = splitters.dtype.itemsize
    cuts = np.searchsorted(np.ascontiguousarray(strings[:, :width]).view(splitters.dtype).ravel(), splitters) if len(splitters) else np.zeros(0, int)
    ends = [0, *cuts.tolist(), len(strings)]
    found = [p for p in range(len(ends) - 1) if ends[p + 1] > ends[p]]
    for p in found:
        a, z = ends[p], ends[p + 1]
        shared, rest = front_code(strings[a:z])
        own, at = np.unique(who[a:z], return_inverse=True)
        table = np.array([keys[x] for x in own.tolist()], "<i8")
        blob = zlib.compress(b"".join([np.array([z - a, len(own)], "<u4").tobytes(), shared.tobytes(), table.tobytes(), at.astype("<u4").tobytes(), place[a:z].astype("<u4").tobytes(), far[a:z].astype(np.uint8).tobytes(), near[a:z].astype(np.uint8).tobytes(), rest]), 1)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([name], pa.string()), pa.array([blob], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=_NAMES)


def _strings(keys, strings, who, place, far, near, length: int, gram: int, parts: int):
    """Of a run's suffixes of common grams: hashes of their strings, dealt by hash, and marks of what repeats inside the run. Strings at different offsets of the anchor differ."""
    ids = np.array(keys, "<i8")
    held, count = [], 0
    for o in range(length - gram + 1):
        at = np.flatnonzero((near <= o) & (o <= far))
        if len(at):
            text = np.concatenate([strings[at, : length - o], strings[at, length : length + o], np.full((len(at), 1), o, np.uint8)], axis=1).tobytes()
            key = np.frombuffer(b"".join(hashlib.blake2b(text[i : i + length + 1], digest_size=16).digest() for i in range(0, len(text), length + 1)), "<u8").reshape(-1, 2)
            start = place[at] - o
            order = np.lexsort((start, who[at], key[:, 1], key[:, 0]))
            key, w, start = key[order], who[at][order], start[order]
            fresh = np.concatenate([[True], (key[1:] != key[:-1]).any(1)])
            lost = ~fresh
            lost[1:] &= ~((w[1:] == w[:-1]) & (start[1:] == start[:-1]))  # rows of one document twice
            yield from _marks(keys, w[lost], start[lost], start[lost] + length, parts)
            rows = np.empty(int(fresh.sum()), _STRING)
            rows["a"], rows["b"], rows["doc"], rows["th"], rows["start"] = *key[fresh].T, *ids[w[fresh]].T, start[fresh]
            held.append(rows)
            count += len(rows)
        if held and (count >= RUN or o == length - gram):
            rows = np.concatenate(held)
            part = (rows["a"] % _U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            found, first = np.unique(part[order], return_index=True)
            blobs, n = [x.tobytes() for x in np.split(rows[order], first[1:])], len(found)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.nulls(n, pa.string()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=_NAMES)
            held, count = [], 0


def _settle_strings(rows: np.ndarray, length: int, parts: int):
    """Marks of all but the earliest of equal strings."""
    rows = rows[np.lexsort([rows[c] for c in ("start", "th", "doc", "b", "a")])]
    same = lambda *c: np.logical_and.reduce([rows[x][1:] == rows[x][:-1] for x in c])
    lost = rows[1:][same("a", "b") & ~same("doc", "th", "start")]
    for i in range(0, len(lost), RUN):
        yield from _batch([((d, t), b, b + length) for _, _, d, t, b in lost[i : i + RUN].tolist()], parts)


def _marks(keys, who, begin, end, parts):
    """A row for each document: its spans as pairs, dealt by document."""
    if not len(who):
        return
    o = np.lexsort((begin, who))
    u, at = np.unique(who[o], return_index=True)
    pairs = np.column_stack([begin[o], end[o]]).astype("<u4")
    s = [joined(x).tobytes() for x in np.split(pairs, at[1:])]
    ids, ths = ([keys[x][i] for x in u.tolist()] for i in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array([(i ^ t) % parts for i, t in zip(ids, ths, strict=True)], pa.int32()), pa.nulls(len(u), pa.string()), pa.nulls(len(u), pa.binary()), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(s, pa.binary())], names=_NAMES)


def joined(pairs: np.ndarray) -> np.ndarray:
    """Spans (begin, end), sorted by begin, as maximal runs."""
    top = np.maximum.accumulate(pairs[:, 1])
    new = np.concatenate([[True], pairs[1:, 0] > top[:-1]])
    at = np.flatnonzero(new)
    return np.column_stack([pairs[at, 0], top[np.append(at[1:], len(pairs)) - 1]])


def _open(piece: bytes, width: int) -> Run:
    data = zlib.decompress(piece)
    n, d = np.frombuffer(data, "<u4", 2).tolist()
    at = 8 + n
    table = [tuple(k) for k in np.frombuffer(data, "<i8", 2 * d, at).reshape(d, 2).tolist()]
    at += 16 * d
    docs = [table[i] for i in np.frombuffer(data, "<u4", n, at).tolist()]
    place = np.frombuffer(data, "<u4", n, at + 4 * n).tolist()
    return Run(data[8 : 8 + n], data[at + 10 * n :], docs, list(zip(place, data[at + 8 * n : at + 9 * n], data[at + 9 * n : at + 10 * n], strict=True)), width)


def _settle(group: list, gram: int, side: int, out: list) -> None:
    """Of sorted suffixes that share the gram, [(suffix, document, (place, far, near), the prefix it shares with the one before)]: for each but the
    earliest of every string the spans it covers.

    The string at offset o before the anchor goes on for ``side - o`` bytes behind the gram. Suffixes share these exactly if no neighbour between
    them shares less, so the shared prefixes cut the sorted group into classes; in a class, the o bytes to the left tell strings apart."""
    if len(group) == 2:
        (a, d, (p, _, _), _), (b, e, (q, _, _), shared) = group
        if (d, p) == (e, q):
            return
        if (e, q) < (d, p):
            far, near, doc, place = *group[0][2][1:], d, p
        else:
            far, near, doc, place = *group[1][2][1:], e, q
        right, left = min(shared - gram, side), max(shared, gram + side)
        while left < gram + 2 * side and a[left] == b[left]:
            left += 1
        hi, lo = min(left - gram - side, far), max(side - right, near)
        if hi >= lo:
            out.append((doc, place - hi, place - lo + gram + side))
        return
    shared = np.array([x[3] for x in group])
    early = sorted(range(len(group)), key=lambda i: (group[i][1], group[i][2][0]))
    lost = np.zeros((len(group), side + 2), np.int8)
    classes = (shared < (gram + side - np.arange(side + 1))[:, None]).cumsum(1)
    for o in range(min(x[2][2] for x in group), max(x[2][1] for x in group) + 1):
        into, seen = classes[o].tolist(), {}
        for i in early:
            s, doc, (place, far, near), _ = group[i]
            if near <= o <= far and seen.setdefault((into[i], s[gram + side : gram + side + o]), (doc, place)) != (doc, place):
                lost[i, o] = 1
    step = np.diff(lost, axis=1, prepend=0)
    for (i, first), (_, end) in zip(np.argwhere(step == 1).tolist(), np.argwhere(step == -1).tolist(), strict=True):
        _, doc, (place, _, _), _ = group[i]
        out.append((doc, place - end + 1, place - first + gram + side))


def _merge(batches, length: int, gram: int, parts: int):
    """Marks go through; pieces of a range are merged and settled, and so are strings of common grams."""
    width, side = gram + 2 * (length - gram), length - gram
    pieces: dict[int, list] = {}
    common: list[np.ndarray] = []
    for b in batches:
        sent = b.filter(b.column(2).is_null())
        if sent.num_rows:
            yield sent.select(["doc_id", "th", "spans"])
        for p, name, piece in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if piece is not None and name is None:
                common.append(np.frombuffer(piece, _STRING))
            elif piece is not None:
                pieces.setdefault(p, []).append((name, piece))
    if common:
        rows = np.concatenate(common)
        common.clear()
        yield from _settle_strings(rows, length, parts)
        del rows
    for p in sorted(pieces):
        runs = [_open(piece, width) for _, piece in sorted(pieces.pop(p))]
        group: list = []
        out: list = []
        for r, shared in merge_runs(runs):
            run = runs[r]
            if shared < gram and group:
                if len(group) > 1:
                    _settle(group, gram, side, out)
                group = []
            group.append((run.head, run.docs[run.i], run.starts[run.i], shared))
            if len(out) > 500_000:
                yield from _batch(out, parts)
                out = []
        if len(group) > 1:
            _settle(group, gram, side, out)
        yield from _batch(out, parts)


def _batch(out: list, parts: int):
    keys = sorted({x[0] for x in out})
    index = {k: i for i, k in enumerate(keys)}
    for m in _marks(keys, np.array([index[x[0]] for x in out], np.int64), np.array([x[1] for x in out], np.int64), np.array([x[2] for x in out], np.int64), parts):
        yield m.select(["doc_id", "th", "spans"])


def dealt_runs(texts: DataFrame, parts: int, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts: doc_id, th, text, no two of equal text. Returns the pieces of all runs, strings of common grams and marks, by the part that settles them."""
    spark = texts.sparkSession
    long = texts.where(F.octet_length("text") >= length)

    def anchors(batches):
        seen, n = [], 0
        for b in batches:
            for _, texts_of in chunks(b.column(0)):
                for part, lo, hi, _ in windows(texts_of, length, gram):
                    place, h = anchored(part, length, gram, lo, hi)[3:]
                    seen.append(h[np.unique(place, return_index=True)[1]])
                    n += len(seen[-1])
                if n > FLUSH:
                    yield from _emit(np.concatenate(seen), FILTER_BITS)
                    seen, n = [], 0
        if n:
            yield from _emit(np.concatenate(seen), FILTER_BITS)

    bits = merged_filter(long.select("text").mapInArrow(anchors, "chunk int, once binary, twice binary"), FILTER_BITS)

    def sample(batches):
        for b in batches:
            for _, part in chunks(b.column(0)):
                for strings, *_ in suffixes(part, bits.value, length, gram):
                    strings = np.ascontiguousarray(strings[::8, :gram])
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in strings], pa.binary())], names=["s"])

    def surroundings(batches):
        for b in batches:
            for _, part in chunks(b.column(0)):
                for strings, *_, h in suffixes(part, bits.value, length, gram):
                    w = np.zeros(len(h), np.uint64)
                    with np.errstate(over="ignore"):
                        for column in strings.T:
                            w = w * _U(0x9E3779B97F4A7C15) + _VALUE_ANY_CASE[column]
                    found = np.unique(np.column_stack([h, w]).view(np.int64), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["h", "w"])

    few = long.where(F.pmod(F.xxhash64("th"), F.lit(SAMPLED)) == 0).select("text")
    often = few.mapInArrow(surroundings, "h long, w long").distinct().groupBy("h").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "h").limit(BROADCAST_KEYS).select("h")
    hot = spark.sparkContext.broadcast(often.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    picked = few.mapInArrow(sample, "s binary")
    spread = picked.distinct().orderBy(F.xxhash64("s")).limit(100 * parts).collect()  # splitters only: they steer load, not results
    found = np.sort(np.array([bytes(r.s) for r in spread], f"S{gram}"))
    splitters = np.unique(found[[len(found) * i // parts for i in range(1, parts)]]) if len(found) >= parts else found
    return long.select("doc_id", "th", "text").mapInArrow(give_back(lambda it: _runs(it, bits, hot, splitters, length, gram, parts)), f"part int, run string, piece binary, {_MARKS}")


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts: doc_id, th, text, no two of equal text. Returns doc_id, th, spans: bytes in strings that also start earlier (several rows a document)."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    return dealt_runs(texts, parts, length, gram).repartitionById(parts, F.col("part")).mapInArrow(give_back(lambda it: _merge(it, length, gram, parts)), _MARKS)


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) if asked for."""
    small_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    keys = plain.select("doc_id", "th", F.sha2("text", 256).alias("sha"))
    owner = cut(keys.groupBy("sha").agg(F.min("doc_id").alias("own"), F.count("*").alias("m")).where("m > 1"))
    copies = cut(spread_join(keys, owner, "sha", heavy_keys(owner, "sha", "m"), F.col("doc_id")).where("doc_id > own").select(F.col("doc_id").alias("cd"), F.col("th").alias("ct")).distinct())
    near = F.broadcast(copies) if copies.count() <= BROADCAST_KEYS else copies
    same = (F.col("doc_id") == F.col("cd")) & (F.col("th") == F.col("ct"))
    marks = repeats(plain.join(near, same, "left_anti"), length)
    per = marks.groupBy("doc_id", "th").agg(F.collect_list("spans").alias("spans")).withColumn("whole", F.lit(False))
    per = per.unionByName(copies.select(F.col("cd").alias("doc_id"), F.col("ct").alias("th"), F.array().cast("array<binary>").alias("spans"), F.lit(True).alias("whole")))

    def strip(batches):
        for b in batches:
            for first, texts in chunks(b.column(1)):
                rows = []
                for t, s, whole in zip(texts, b.column(2).slice(first, len(texts)).to_pylist(), b.column(3).slice(first, len(texts)).to_pylist(), strict=True):
                    kept, removed, n = t, 0, 0
                    if whole and len(t) >= length:
                        kept, removed, n = b"", len(t), 1
                    elif s:
                        pairs = np.frombuffer(b"".join(s), "<u4").reshape(-1, 2)
                        begin, end = joined(pairs[np.argsort(pairs[:, 0], kind="stable")]).T
                        keep = np.ones(len(t) + 1, np.int8)
                        for a, z in zip(begin.tolist(), end.tolist(), strict=True):
                            keep[a:z] = 0
                        kept = np.frombuffer(t, np.uint8)[keep[:-1].astype(bool)].tobytes()
                        removed, n = len(t) - len(kept), len(begin)
                    rows.append((len(t), removed, n, hashlib.sha256(kept).hexdigest(), kept))
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), *(pa.array(c[i], pa.int64()) for i in range(3)), pa.array(c[3]), *[pa.array(c[4], pa.binary())] * with_text],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text],
                )

    both = plain.join(per, ["doc_id", "th"], "left").select("doc_id", "text", "spans", "whole")
    out = both.mapInArrow(give_back(strip), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
