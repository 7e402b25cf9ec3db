"""Word shingles of whole texts as 64-bit hashes, with numpy over many texts at once; a bounded sketch of their frequencies."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, give_back

CHUNK_BYTES = 1 << 19
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
_VALUE_ANY_CASE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE = _VALUE_ANY_CASE[_LOWER]
_FACTOR = np.random.default_rng(8).integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30)) ^ _U(salt)) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; n is at most a window and its margins, so what is kept has a fixed size."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def hashed_runs(data: np.ndarray, solid: np.ndarray, values: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of bytes that ``solid`` (a table) marks: its polynomial hash, where it starts, and its length. Works in windows of
    a fixed size; a run that crosses windows is put together from its parts."""
    hashes, starts, lengths = [], [], []
    open_h, open_at, open_n = 0, 0, 0
    for a in range(0, len(data), CHUNK_BYTES * 2):
        d = data[a : a + CHUNK_BYTES * 2]
        edge = np.flatnonzero(np.diff(solid[d], prepend=False, append=False))
        start, end = edge[::2], edge[1::2]
        p, inverse = powers(len(d))
        with np.errstate(over="ignore"):
            run = np.cumsum(values[d] * p)
            h = (run[end - 1] - run[start] + values[d[start]] * p[start]) * inverse[start]
        n = end - start
        if open_n:
            if len(start) and start[0] == 0:  # the open run goes on
                open_h = (open_h + pow(_BASE, open_n, 1 << 64) * int(h[0])) & 0xFFFFFFFFFFFFFFFF
                open_n += int(n[0])
                h, start, n = h[1:], start[1:], n[1:]
                if open_n + open_at == a + len(d) and a + len(d) < len(data):
                    continue
            hashes.append(np.array([open_h], np.uint64))
            starts.append(np.array([open_at]))
            lengths.append(np.array([open_n]))
            open_n = 0
        if len(start) and start[-1] + n[-1] == len(d) and a + len(d) < len(data):
            open_h, open_at, open_n = int(h[-1]), a + int(start[-1]), int(n[-1])
            h, start, n = h[:-1], start[:-1], n[:-1]
        hashes.append(h)
        starts.append(start + a)
        lengths.append(n)
    if open_n:
        hashes.append(np.array([open_h], np.uint64))
        starts.append(np.array([open_at]))
        lengths.append(np.array([open_n]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(lengths)


def scattered(data: np.ndarray, solid: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Of every run, the sum of a nonlinear function of each byte (A-Z as a-z) and its place. A polynomial modulo 2**64 has whole families of words that collide
    whatever base and values are (those that follow the Thue-Morse sequence); this sum has no such algebra. In windows, as ``hashed_runs``."""
    out, end = np.zeros(len(start), np.uint64), start + length
    for a in range(0, len(data) if len(start) else 0, CHUNK_BYTES * 2):
        d = data[a : a + CHUNK_BYTES * 2]
        r0, r1 = np.searchsorted(end, a, side="right"), np.searchsorted(start, a + len(d))
        if r0 == r1:
            continue
        count = np.minimum(end[r0:r1], a + len(d)) - np.maximum(start[r0:r1], a)
        at = np.flatnonzero(solid[d])
        with np.errstate(over="ignore"):
            x = (at + a - np.repeat(start[r0:r1], count)).astype(np.uint64)
            x *= _U(0xD6E8FEB86659FD93)
            x ^= _VALUE[d[at]]
            x ^= x >> _U(32)
            x *= _U(0xBF58476D1CE4E5B9)
            x ^= x >> _U(29)
            x *= _U(0x94D049BB133111EB)
            x ^= x >> _U(31)
            out[r0:r1] += np.add.reduceat(x, np.cumsum(count) - count)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line end behind each, and where each starts (len(texts) + 1)."""
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts (A-Z as a-z), and where each text's words start (len(texts) + 1)."""
    data, first = joined(texts)
    word, start, n = hashed_runs(data, _SOLID)
    with np.errstate(over="ignore"):
        word += n.astype(np.uint64) * _U(_BASE)
        return mix(word) + scattered(data, _SOLID, start, n), np.searchsorted(start, first)


def shingle_sets(texts: list[bytes], q: int) -> list[np.ndarray]:
    """For each text its distinct shingles of q words, sorted; the whole sequence as one if it has fewer words."""
    w, at = word_hashes(texts)
    with np.errstate(over="ignore"):
        whole = mix(sum((w[i : len(w) - q + 1 + i] * _FACTOR[i] for i in range(1, q)), w[: max(0, len(w) - q + 1)] * _FACTOR[0])) if len(w) >= q else w[:0]
        out = []
        for a, z in zip(at, at[1:], strict=False):
            if z - a >= q:
                out.append(np.unique(whole[a : z - q + 1]))
            elif z > a:
                out.append(mix(sum((w[a + i : a + i + 1] * _FACTOR[i] for i in range(z - a)), np.full(1, z - a, np.uint64)), 1))
            else:
                out.append(w[:0])
    return out


def chunks(column: pa.Array):
    """(first row, texts as bytes) of at most about CHUNK_BYTES, or of one text. Cut by the column's own offsets, so no more than that is copied at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first, done = 0, 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")))
        yield first, [t or b"" for t in column.slice(first, last - first).cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
        first, done = last, int(ends[last - 1])


LOG2_COUNTERS, PART = 22, 1 << 16


def frequency_levels(texts: DataFrame, q: int) -> Shared:
    """A level for each counter of a sketch of all shingles of all texts: 0 for what noise may explain, more with the
    logarithm of the count. Counters have a fixed number (4 MB as sent); the levels only order shingles, so no result rests on them."""

    @give_back
    def count(batches):
        total = np.zeros(1 << LOG2_COUNTERS, np.int32)
        some = False
        for b in batches:
            for _, part in chunks(b.column(0)):
                np.add.at(total, (np.concatenate(shingle_sets(part, q)) >> _U(64 - LOG2_COUNTERS)).astype(np.int64), 1)
                some = True
        for c in range(len(total) // PART if some else 0):
            x = total[c * PART : (c + 1) * PART]
            small = x.max() < 256
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([bool(small)]), pa.array([zlib.compress(x.astype(np.uint8 if small else np.int32).tobytes(), 1)], pa.binary())], names=["c", "small", "n"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, small, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                sums[c] = sums.get(c, 0) + np.frombuffer(zlib.decompress(n), np.uint8 if small else np.int32).astype(np.int64)
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], names=["c", "n"])

    merged = texts.mapInArrow(count, "c int, small boolean, n binary").repartition(64, "c").mapInArrow(merge, "c int, n binary")
    total = np.zeros(1 << LOG2_COUNTERS, np.int64)
    for r in merged.collect():  # the sketch's fixed size
        total[r.c * PART : (r.c + 1) * PART] = np.frombuffer(zlib.decompress(r.n), np.int64)
    mean = total.mean()
    over = np.maximum(0, total - mean - 3 * np.sqrt(mean))
    return Shared(texts.sparkSession, np.minimum(255, 4 * np.log2(1 + over)).astype(np.uint8))


def in_order(s: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in the global order (rare levels first, then by hash), and its levels."""
    lv = levels[s >> _U(64 - LOG2_COUNTERS)]
    o = np.argsort(lv, kind="stable")
    return s[o], lv[o]
