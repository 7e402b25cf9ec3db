"""Two-bit Bloom filter over 64-bit hashes: which bits are set once, and which by two partitions or by a repeat.

Each partition sends the positions of its bits, not whole bitmaps, so what is shuffled follows the rows. Merging streams over
fixed-size chunks of the filter. The result, one bit for each position, has a size fixed by ``log2_bits`` (2**27 bits: 16 MB);
when the input outgrows it, more rows count as possibly repeated and take the exact path, and results stay the same.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, give_back

LOG2_BITS = 27
CHUNK_LOG2 = 18
#: So many hashes of a task are sorted at a time.
FLUSH = 500_000


def positions(h: np.ndarray, log2_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash (uint64)."""
    with np.errstate(over="ignore"):
        g = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    s = np.uint64(64 - log2_bits)
    with np.errstate(over="ignore"):
        return g >> s, (g * np.uint64(0xD6E8FEB86659FD93)) >> s


def _steps(at: np.ndarray) -> bytes:
    """Ascending places as their differences, in two bytes each where these suffice."""
    d = np.diff(at.astype(np.int64), prepend=0)
    return b"" if not len(d) else b"2" + d.astype("<u2").tobytes() if d.max() < 1 << 16 else b"4" + d.astype("<u4").tobytes()


def _places(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, f"<u{data[:1].decode()}", -1, 1).astype(np.int64)) if data else np.zeros(0, np.int64)


@give_back
def _local(batches, log2_bits: int):
    seen = []
    for b in batches:
        h = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        seen.append(h)
        if sum(map(len, seen)) > FLUSH:
            yield from _emit(np.concatenate(seen), log2_bits)
            seen = []
    if seen:
        yield from _emit(np.concatenate(seen), log2_bits)


def _emit(h: np.ndarray, log2_bits: int):
    u, n = np.unique(h, return_counts=True)
    once = np.unique(np.concatenate(positions(u, log2_bits)))
    twice = np.unique(np.concatenate(positions(u[n > 1], log2_bits)))
    cuts = np.arange(0, 1 << log2_bits, 1 << CHUNK_LOG2, dtype=np.uint64)
    ends = np.append(np.searchsorted(once, cuts), len(once))
    ends2 = np.append(np.searchsorted(twice, cuts), len(twice))
    rows = [i for i in range(len(cuts)) if ends[i + 1] > ends[i]]
    low = np.uint64((1 << CHUNK_LOG2) - 1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(rows, pa.int32()),
            pa.array([_steps(once[ends[i] : ends[i + 1]] & low) for i in rows], pa.binary()),
            pa.array([_steps(twice[ends2[i] : ends2[i + 1]] & low) for i in rows], pa.binary()),
        ],
        names=["chunk", "once", "twice"],
    )


@give_back
def _merge(batches):
    chunks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in batches:
        for c, once, twice in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if c not in chunks:
                chunks[c] = np.zeros(1 << CHUNK_LOG2, bool), np.zeros(1 << CHUNK_LOG2, bool)
            one, two = chunks[c]
            at = _places(once)
            two[at[one[at]]] = True
            one[at] = True
            two[_places(twice)] = True
    for c, (_, two) in chunks.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(np.packbits(two).tobytes(), 1)], pa.binary())], names=["chunk", "bits"])


def merged_filter(parts: DataFrame, log2_bits: int = LOG2_BITS) -> Shared:
    """The filter's bits that were set more than once. parts: what _emit makes of each partition."""
    merged = parts.repartition(64, "chunk").mapInArrow(_merge, "chunk int, bits binary")
    whole = np.zeros((1 << log2_bits) // 8, np.uint8)
    size = (1 << CHUNK_LOG2) // 8
    for r in merged.collect():  # the filter's fixed size in all, whatever the input
        whole[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return Shared(parts.sparkSession, whole)


def repeated_filter(hashes: DataFrame, log2_bits: int = LOG2_BITS) -> Shared:
    """The same for rows of hashes (one long column)."""
    known = hashes.where(F.col(hashes.columns[0]).isNotNull())
    return merged_filter(known.mapInArrow(lambda it: _local(it, log2_bits), "chunk int, once binary, twice binary"), log2_bits)


def maybe_repeated(h: np.ndarray, bits: np.ndarray, log2_bits: int = LOG2_BITS) -> np.ndarray:
    """For each hash (uint64), whether both of its bits were set more than once."""
    out = np.ones(len(h), bool)
    for p in positions(h, log2_bits):
        out &= (bits[p >> np.uint64(3)] >> (np.uint8(7) - (p & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
    return out
