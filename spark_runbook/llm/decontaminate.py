"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Every item gives its windows: runs of ten words, or the whole item if it is shorter. A window must be contained whole, so of its
shingles (three words; fewer for shorter windows), ordered by rarity over all documents, one is a sufficient prefix: the rarest. A
document position joins a window where the shingle there is the window's prefix token. Its offset in the window fixes where the
window would have to start (positional bound), the window must end inside the document (length bound), and then the words are
compared exactly. A window with a shingle that no document has is gone before the join.

The windows are broadcast while they are at most ``BROADCAST_WINDOWS``; beyond, candidates are found by a shuffled join that carries
ids and positions, and the words are joined back for the comparison.

Defined results: null or wordless text has no words and no hits; null item ids aren't reported; equal rows get equal
results; empty tables give no hits; of other columns none is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, renamed, text_or_empty

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
BROADCAST_WINDOWS = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def _hash(ws: Column, at: Column, q: int) -> Column:
    return F.xxhash64(*(F.get(ws, at + i) for i in range(q)))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row a distinct window: ws (its words), len, items (ids as text)."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words(text_or_empty(text_col)).alias("ws")).where(F.size("ws") > 0)
    w = w.withColumn("len", F.least(F.size("ws"), F.lit(size)))
    at = w.select("item", "len", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("len"))).alias("i"))
    return at.select("item", "len", F.expr("slice(ws, i + 1, len)").alias("ws")).groupBy("ws", "len").agg(F.collect_set("item").alias("items"))


def _positions(docs: DataFrame, q: int, *keep: str) -> DataFrame:
    """A row for each word that starts a shingle of q words: keep, n, p, h."""
    at = docs.where(F.size("ws") >= q).select(*keep, F.size("ws").alias("n"), F.posexplode("ws").alias("p", "w"), *({"ws"} - set(keep)))
    return at.where(F.col("p") + q <= F.col("n")).select(*keep, "n", "p", _hash(F.col("ws"), F.col("p"), q).alias("h"))


def hits(docs: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Occurrences of windows. docs: key columns and ws. Returns key, start, len, items."""
    keys = [c for c in docs.columns if c != "ws"]
    n_windows, longest = (lambda r: (r[0], r[1] or []))(windows.agg(F.count("*"), F.collect_set(F.least("len", F.lit(SHINGLE)))).first())
    small = n_windows <= broadcast_windows
    near = F.broadcast if small else (lambda x: x)
    found = []
    for q in sorted(longest):
        win = windows.where(F.least("len", F.lit(SHINGLE)) == q)
        shingles = win.select("ws", "len", "items", F.explode(F.sequence(F.lit(0), F.col("len") - q)).alias("j")).withColumn("h", _hash(F.col("ws"), F.col("j"), q))
        rarity = _positions(docs, q, *keys).select("h").join(near(shingles.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("df"))
        prefix = shingles.join(rarity, "h", "left").groupBy("ws", "len", "items").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "j", "h")).alias("r"))
        prefix = prefix.where("r.df > 0").select(F.col("ws").alias("win"), "len", "items", "r.j", "r.h")
        cand = _positions(docs, q, *keys, *["ws"] * small).join(near(prefix), "h").withColumn("start", F.col("p") - F.col("j"))
        cand = cand.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n")))
        if not small:
            k = [F.col(f"c.{c}").eqNullSafe(F.col(f"d.{c}")) for c in keys]
            cand = cand.alias("c").join(docs.dropDuplicates(keys).alias("d"), reduce(lambda a, b: a & b, k)).select(*(f"c.{c}" for c in keys), "start", "len", "items", "win", "ws")
        found.append(cand.where(F.expr("slice(ws, start + 1, len) = win")).select(*keys, "start", "len", "items"))
    return reduce(DataFrame.unionByName, found) if found else None


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row a row of docs: its id, its text's hash, n_words, n_hit, n_items, items_sha256, contaminated."""
    text = text_or_empty(text_col)
    key = [F.col(id_col).alias("__id"), F.xxhash64(text).alias("__h")]
    found = hits(docs.select(*key, words(text).alias("ws")), item_windows(items), broadcast_windows)
    every = docs.select(*key, F.regexp_count(text, F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"))
    if found is None:
        every = every.select("*", F.lit(None).cast("array<string>").alias("__items"), F.lit(None).cast("long").alias("n_hit"))
    else:
        per = found.groupBy("__id", "__h").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))
        covered = F.aggregate(
            "runs",
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda a, r: F.struct(F.greatest(a["end"], r["start"] + r["len"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), r["start"] + r["len"] - F.greatest(a["end"], r["start"]))).alias("sum")),
            lambda a: a["sum"].cast("long"),
        )
        per = per.select(F.col("__id").alias("i"), F.col("__h").alias("h"), "__items", covered.alias("n_hit"))
        every = every.join(per, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__h") == F.col("h")), "left")
    items_of = F.coalesce("__items", F.array().cast("array<string>"))
    return every.select(
        F.col("__id").alias(id_col), "__h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs without the documents in which a window occurs; same columns, whatever their names."""
    plain, (i, t), restore = renamed(docs, id_col, text_col)
    text = text_or_empty(t)
    key = [F.col(i).alias("__id"), F.xxhash64(text).alias("__h")]
    found = hits(plain.select(*key, words(text).alias("ws")), item_windows(items), broadcast_windows)
    if found is None:
        return docs
    bad = found.select(F.col("__id").alias("__bad_i"), F.col("__h").alias("__bad_h")).distinct()
    return restore(plain.join(bad, F.col(i).eqNullSafe(F.col("__bad_i")) & (F.xxhash64(text) == F.col("__bad_h")), "left_anti"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS s FROM (SELECT item, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM bl)),
pos AS (SELECT rid, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s
        FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
occ AS (SELECT rid, p, k, item FROM pos JOIN win USING (k, s)),
cov AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT rid, p, k FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""
