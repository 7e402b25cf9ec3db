"""Centroid clustering (Lloyd's rounds) in exact integers, with lower bounds loosened by geometry.

A vector keeps its cluster, an upper bound u of the distance to its own centroid and a lower bound l of that to all others. When centroids move,
u grows by its own centroid's drift. l shrinks by less than the largest drift: the vectors of cluster j lie in a sphere around its old
centroid m, of the largest u of the cluster, and on m's side of the plane half way to the other centroid. For another centroid that moves from a to b, with
middle h, unit direction w and drift e, a vector x comes closer by 2 e ((x - h) w) / (|x - a| + |x - b|), which is at most e times the cosine of the angle at h
between x - h and w, as the denominator is at least 2 |x - h|. So everything happens in the plane of m, h and w, where the sphere is a disc (``loosened``):
the cosine is at most that of the angle between m - h and w less the disc's half angle, and at most the disc's largest extent along w over the
smallest |x - h|. A vector whose u stays below l, or below half the distance from its centroid to the next one, keeps its cluster. The others are compared with their own
centroid, and if that doesn't settle it, with all of them (``scanned``): in integers, so ties and assignments are those of a full scan.

Each round is one pass over a written table of vectors and bounds; a task adds one row of sums for each cluster to it, so a cluster of any size is summed where its
vectors are. The driver holds centroids only (k times dim numbers).

Defined results: vectors that are null, of another length, or with a null, NaN or infinite component are left out; of equal distances the smaller centroid wins, so
of equal centroids the later is empty and stays where it is; with fewer vectors than k there are as many centroids as vectors; null ids are
clustered, but start no centroid while others are there; repeated rows are vectors of their own; an empty table gives an empty result; a component so large that exact
distances leave 64 bits raises an error (``limit``); other columns of the input aren't read.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

SCALE, DIM, CENTROIDS, ROUNDS = 64, 64, 16, 3
EPS = 1e-9  # float bounds are widened by this part, far more than their rounding
STATE = "id long, v array<int>, c int, u double, l double, d long, part struct<n:long,most:double,sums:array<long>>"
_PART = pa.struct([("n", pa.int64()), ("most", pa.float64()), ("sums", pa.list_(pa.int64()))])


def limit(dim: int) -> int:
    """Largest component for which dim squared differences add up to less than 2**62."""
    return isqrt((1 << 60) // max(1, dim))


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: the kept vectors as integers floor(scale * x)."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))
    large = F.exists(v, lambda x: F.abs(x.cast("double") * scale) >= limit(dim))
    kept = vectors.where((F.size(v) == dim) & ~bad).select(F.col(id_col).cast("long").alias("id"), v.alias(vec_col))
    return kept.select("id", F.when(large, F.raise_error(F.lit("a component is too large for exact distances")).cast("array<int>")).otherwise(whole).alias("v"))


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by centroids; by floating point where all sums stay below 2**53."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if v.shape[1] * (2 * most) ** 2 < 1 << 53 else np.int64
    a, b = v.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def to_own(v: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    x = v - c[own]
    return (x * x).sum(1)


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the lower bounds of its vectors shrink when centroids move from old to new; radius: that of its sphere around the old one."""
    a, b = old.astype(float), new.astype(float)
    k = len(a)
    drift = np.sqrt(((b - a) ** 2).sum(1))
    w = np.divide(b - a, drift[:, None], out=np.zeros_like(a), where=drift[:, None] > 0)
    h = (a + b) / 2
    along = a @ w.T - (h * w).sum(1)[None, :]  # of m - h on w: rows are spheres, columns moved centroids
    apart = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (h * h).sum(1)[None, :] - 2 * a @ h.T))
    r = radius[:, None] * (1 + EPS)
    outside = apart > r * (1 + EPS) + EPS
    cos = np.clip(np.divide(along, apart, out=np.ones_like(along), where=apart > 0), -1, 1)
    sin_disc = np.divide(r, apart, out=np.ones_like(along), where=outside)
    cos_disc = np.sqrt(np.maximum(0, 1 - sin_disc**2))
    cone = np.where(cos >= cos_disc, 1.0, cos * cos_disc + np.sqrt(np.maximum(0, 1 - cos**2)) * sin_disc)
    cone = np.where(outside, cone, 1.0)
    half = np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (a * a).sum(1)[None, :] - 2 * a @ a.T)) / 2
    nearest = half - drift[None, :] / 2 - EPS
    extent = np.divide(along + r, nearest, out=np.ones_like(along), where=nearest > EPS)
    share = np.minimum(1.0, np.minimum(cone, extent) + 1e-7)  # the margin is above the rounding of square roots near 0
    loss = np.maximum(0, share) * drift[None, :]
    loss[np.arange(k), np.arange(k)] = 0
    return loss.max(1, initial=0) * (1 + EPS)


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one."""
    d = distances(c, c).astype(float)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(1, initial=np.inf)) / 2


def scanned(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the first), its exact squared distance, and the distance to the second."""
    d = distances(v, c)
    own = d.argmin(1)
    rows = np.arange(len(v))
    best = d[rows, own]
    rest = d.astype(float)
    rest[rows, own] = np.inf
    return own, best, np.sqrt(rest.min(1, initial=np.inf)) * (1 - EPS)


def _pass(rows: DataFrame, c: np.ndarray, moved: tuple[np.ndarray, np.ndarray] | None, last: bool) -> DataFrame:
    """One assignment of all vectors, and each task's sums. moved: each centroid's drift, and what the lower bounds of its vectors lose; without it all are scanned."""
    gaps = half_gaps(c)

    @give_back
    def assign(batches):
        k, dim = c.shape
        n, most, sums = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy().reshape(-1, dim).astype(np.int64)
            if moved is None:
                own, d, low = scanned(v, c)
                up = np.sqrt(d.astype(float)) * (1 + EPS)
            else:
                own = batch.column("c").to_numpy().astype(np.int64)
                up = batch.column("u").to_numpy() + moved[0][own]
                low = batch.column("l").to_numpy() - moved[1][own]
                d = to_own(v, c, own) if last else np.zeros(len(v), np.int64)
                open_ = np.flatnonzero(~(up < np.maximum(low, gaps[own] * (1 - EPS)) - EPS))
                if len(open_):
                    d[open_] = to_own(v[open_], c, own[open_])
                    up[open_] = np.sqrt(d[open_].astype(float)) * (1 + EPS)
                    open_ = open_[~(up[open_] < np.maximum(low[open_], gaps[own[open_]] * (1 - EPS)) - EPS)]
                if len(open_):
                    own[open_], d[open_], low[open_] = scanned(v[open_], c)
                    up[open_] = np.sqrt(d[open_].astype(float)) * (1 + EPS)
            np.add.at(n, own, 1)
            np.maximum.at(most, own, up)
            np.add.at(sums, own, v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(own, pa.int32()), pa.array(up), pa.array(low), pa.array(d, pa.int64()), pa.nulls(len(v), _PART)], names=["id", "v", "c", "u", "l", "d", "part"]
            )
        some = np.flatnonzero(n)
        part = pa.array([{"n": int(n[j]), "most": float(most[j]), "sums": sums[j].tolist()} for j in some], _PART)
        none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), *(pa.nulls(len(some), t) for t in (pa.float64(), pa.float64(), pa.int64())), part], names=["id", "v", "c", "u", "l", "d", "part"])

    return cut(rows.mapInArrow(assign, STATE))


def _sums(state: DataFrame, dim: int) -> dict[int, tuple[int, float, list[int]]]:
    """Count, radius and component sums of each cluster: a row a cluster to the driver."""
    g = state.where("part is not null").groupBy("c").agg(F.sum("part.n"), F.max("part.most"), *(F.sum(F.col("part.sums")[i]) for i in range(dim)))
    return {r[0]: (r[1], r[2], list(r[3:])) for r in g.collect()}


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Assigned vectors (id, c, d: the exact squared distance) and the final centroids.

    Centroids start as the k vectors with the smallest SHA-256 of "seed:id"; each round assigns all vectors and puts a centroid that has any at the floor of their mean."""
    ints = integer_vectors(vectors, dim, scale, id_col, vec_col)
    first = ints.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r.v for r in first], np.int64).reshape(len(first), dim)
    rows = ints.select("id", "v")
    moved = None
    for i in range(rounds if len(c) else 0):
        state = _pass(rows, c, moved, False)
        sums = _sums(state, dim)
        new = c.copy()
        for j, (n, _, total) in sums.items():
            new[j] = [s // n for s in total]
        radius = np.array([sums[j][1] if j in sums else 0.0 for j in range(len(c))])
        moved = np.sqrt(((new - c).astype(float) ** 2).sum(1)) * (1 + EPS), loosened(c, new, radius)
        rows, c = state.where("part is null").select("id", "v", "c", "u", "l"), new
    if not len(c):
        return ints.select("id", F.lit(0).alias("c"), F.lit(0).cast("long").alias("d")), c
    return _pass(rows, c, moved, True).where("part is null").select("id", "c", "d"), c


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components: 16 centroids, three rounds."""
    assigned, c = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shas = [(j, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for j, x in enumerate(c)]
    of = spark.createDataFrame(shas, "c int, centroid_sha256 string").join(assigned.groupBy("c").agg(F.sum("d").alias("cluster_inertia")), "c")
    table = F.broadcast(of.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy())))  # a row a centroid
    return assigned.join(table, "c").select(F.col("id").alias("vec_id"), F.col("c").alias("cluster"), F.col("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(r: int) -> str:
    return f"""
a{r} AS (SELECT rid, k, d FROM (SELECT rid, k, sum((p.x - q.x) * (p.x - q.x)) AS d FROM vd p JOIN c{r} q USING (i) GROUP BY rid, k) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1),
s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{r} JOIN vd USING (rid) GROUP BY k, i),
c{r + 1} AS (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{r} LEFT JOIN s{r} USING (k, i)),"""


OP12_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
              WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
vd AS (SELECT rid, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
c0 AS (SELECT k, unnest(range(64)) AS i, unnest(v) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept) WHERE k < 16),
{"".join(_round_sql(r) for r in range(ROUNDS + 1))}
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS sha FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (rid) JOIN h USING (k)
"""
