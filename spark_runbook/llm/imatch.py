"""I-Match fingerprints over randomised lexicon subsets, in DataFrame operations only.

The lexicon are the terms whose inverse document frequency lies in a band: with N documents, df between N ** (1 - ``BAND[1]``) and
N ** (1 - ``BAND[0]``), so neither unique nor common ones, at every size of the corpus. A hash of each term deals the lexicon into ``SUBSETS`` random
subsets; each subset is thinned by powers of two (thinning l keeps a 2 ** l-th of it), so that long texts have few terms of a subset as well. A text's
level is the thinning that leaves it half a term to one a subset (fewer than 16 terms stay whole). Its fingerprint are the hashes of its sorted distinct terms in each subset, at
its level and at the next one: two texts whose sizes differ less than twofold share a level. ``likeness`` is the part of subsets with equal hashes among those
in which one of the two has terms, at the common level.

Only the terms that a text's level keeps (8 to 16 of them, however long it is) are joined to the lexicon; frequent terms are dealt over
many tasks, and those above the band that make up more than a 500th of all rows (so at most 500 terms) are dropped before the shuffle.

Defined results: null text counts as empty; a text without a term of the lexicon at its level has the hash of the whole text for its fingerprint
("=" and the hash) and is like equal texts only; rows that share id and text are one document with equal results, followed by the next
different row; rows of one id go by a hash of the text; null ids come first; after the last document comes the first, so a single one follows itself; an empty table gives
an empty result; texts of any length are read whole; no other column of the input is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY, cut, spread_join, text_or_empty
from .decontaminate import words

SUBSETS, BAND, DIGITS = 16, (0.15, 0.95), 10


def term_hash(word: Column) -> Column:
    """60 bits."""
    return F.conv(F.substring(F.md5(word), 1, 15), 16, 10).cast("long")


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    return F.transform(F.array_distinct(words(text)), term_hash)


def df_bounds(n: int, band: tuple[float, float] = BAND) -> tuple[int, int]:
    """Least and largest document frequency in the band among n documents; the margin keeps whole powers on the inner side."""
    low, high = n ** (1 - band[1]) - 1e-9, n ** (1 - band[0]) + 1e-9
    return max(1, -int(-low // 1)), int(high)


def frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """t, df: in how many documents each term is."""
    return docs.select(F.explode(terms(text_or_empty(text_col))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))


def level_of(n_terms: Column) -> Column:
    """The thinning that leaves 8 to 15 terms: 0 for fewer than 16 of them, 1 for 16 to 31, and so on."""
    return F.greatest(F.lit(0), F.length(F.bin(n_terms)) - 4)


def kept_at(t: Column, level: Column) -> Column:
    """Whether thinning by the level keeps the term."""
    return t % F.call_function("shiftleft", F.lit(SUBSETS).cast("long"), level) < SUBSETS


def _kept(ts: Column, level: Column) -> Column:
    return F.filter(ts, lambda t: kept_at(t, level))


def _signatures(ts: Column, level: Column) -> Column:
    """A hash a subset of its sorted terms that the level keeps, empty where there is none."""

    def one(k):
        mine = F.filter(_kept(ts, level), lambda t: t % SUBSETS == k)
        return F.when(F.size(mine) > 0, F.substring(F.md5(F.array_join(F.transform(F.array_sort(mine), lambda t: t.cast("string")), ",")), 1, DIGITS)).otherwise("")

    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), one)


def _print(ts: Column, level: Column, whole: Column) -> Column:
    both = F.concat(level.cast("string"), F.lit(":"), F.array_join(_signatures(ts, level), ","), F.lit(";"), F.array_join(_signatures(ts, level + 1), ","))
    return F.when(F.coalesce(F.size(ts), F.lit(0)) > 0, both).otherwise(F.concat(F.lit("="), whole))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal subsets of two fingerprints among those where one has terms, at their common level; 0 without one."""
    part = lambda f, i: F.split(F.split(F.substring_index(f, ":", -1), ";")[i], ",")
    level = lambda f: F.substring_index(f, ":", 1).try_cast("int")

    def share(x, y):
        z = F.arrays_zip(x.alias("x"), y.alias("y"))
        some = F.size(F.filter(z, lambda e: (e["x"] != "") | (e["y"] != "")))
        return F.coalesce(F.try_divide(F.size(F.filter(z, lambda e: (e["x"] != "") & (e["x"] == e["y"]))).cast("double"), some.cast("double")), F.lit(0.0))

    apart = level(a) - level(b)
    return F.when(a == b, 1.0).when(apart == 0, share(part(a, 0), part(b, 0))).when(apart == -1, share(part(a, 1), part(b, 0))).when(apart == 1, share(part(a, 0), part(b, 1))).otherwise(0.0)


def fingerprints(texts: DataFrame, cols: list[str], docs: DataFrame, text_col: str = "text") -> DataFrame:
    """texts with each of the text columns ``cols`` replaced by its fingerprint, by the lexicon of docs."""
    low, high = df_bounds(docs.count())
    lexicon = cut(frequencies(docs, text_col).where(F.col("df") >= low))
    rest = [c for c in texts.columns if c not in cols]
    ts = texts.select(*rest, *(terms(F.col(c)).alias(f"__t{i}") for i, c in enumerate(cols)), *(F.unhex(F.md5(c)).alias(f"__w{i}") for i, c in enumerate(cols)))
    ts = ts.withColumns({f"__l{i}": level_of(F.size(f"__t{i}")) for i in range(len(cols))})
    ts = ts.withColumns({f"__t{i}": _kept(F.col(f"__t{i}"), F.col(f"__l{i}")) for i in range(len(cols))})
    kept = cut(ts.withColumn("__row", F.monotonically_increasing_id()))
    total = lexicon.agg(F.sum("df")).first()[0] or 0
    heavy = lexicon.where(F.col("df") > max(200, total // HEAVY)).collect()  # at most HEAVY, as their df add up to total
    common = [r.t for r in heavy if r.df > high]
    asked = kept.select("__row", F.explode(F.array_distinct(F.flatten(F.array(*(f"__t{i}" for i in range(len(cols))))))).alias("t"))
    if common:
        asked = asked.where(~F.col("t").isin(common))
    found = spread_join(asked, lexicon.where(F.col("df") <= high).select("t"), "t", [r.t for r in heavy if r.df <= high], F.col("__row"))
    banded = found.groupBy("__row").agg(F.collect_list("t").alias("__in"))
    every = kept.join(banded, "__row", "left")
    every = every.withColumns({f"__t{i}": F.array_intersect(f"__t{i}", "__in") for i in range(len(cols))})
    return every.select(*rest, *(_print(F.col(f"__t{i}"), F.col(f"__l{i}"), F.lower(F.hex(f"__w{i}"))).alias(c) for i, c in enumerate(cols)))


def followers(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys (distinct rows of ``order``) with ``next``, the struct of the row after each, the first one after the last.

    Rows are dealt by ranges and written, so that ranges and places agree; what follows a range's last row is the first row of a later range, one row a range."""
    row = F.struct(*order)
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(keys.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    firsts = dealt.groupBy("__part").agg(F.min(row).alias("f"))
    after = firsts.select("__part", F.coalesce(F.lead("f").over(Window.orderBy("__part")), F.min("f").over(Window.partitionBy())).alias("__after"))
    within = dealt.withColumn("next", F.lead(row).over(Window.partitionBy("__part").orderBy(*order)))
    return within.join(F.broadcast(after), "__part").select(*keys.columns, F.coalesce("next", "__after").alias("next"))


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, y: x & y, (a[p].eqNullSafe(b[q]) for p, q in pairs))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __h (its text's hash), n_chars, text, edited (the last quarter replaced by the next document's first characters), __next_id, __next_h."""
    d = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text")).withColumn("__h", F.xxhash64("text"))
    ids = d.groupBy("__id", "__h").agg(F.max(F.length("text").cast("long")).alias("n_chars"))
    follow = followers(ids, ["__id", "__h"]).select(F.col("__id").alias("i"), F.col("__h").alias("h"), "n_chars", F.col("next.__id").alias("__next_id"), F.col("next.__h").alias("__next_h"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    heads = d.join(follow, _same(d, follow, [("__id", "__next_id"), ("__h", "__next_h")])).select("i", "h", "n_chars", "__next_id", "__next_h", F.left("text", quarter).alias("head")).dropDuplicates(["i", "h"])
    both = d.join(heads, _same(d, heads, [("__id", "i"), ("__h", "h")]))
    return both.select("__id", "__h", "n_chars", "text", F.concat(F.left("text", F.col("n_chars").cast("int") - quarter), "head").alias("edited"), "__next_id", "__next_h")


def op11_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike each is to its edited text and to the next document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = edited_texts(docs).withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    p = fingerprints(texts, ["text", "edited"], docs)
    q = p.select(F.col("__id").alias("i"), F.col("__h").alias("h"), F.col("text").alias("other")).dropDuplicates(["i", "h"])
    return p.join(q, _same(p, q, [("__next_id", "i"), ("__next_h", "h")])).select(
        F.col("__id").alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("other")).alias("near_next"),
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rn, count(*) OVER () AS n_docs FROM documents),
e AS (SELECT a.doc_id, a.rn, b.rn AS next_rn, CAST(length(a.t) AS BIGINT) AS n_chars, a.t, left(a.t, length(a.t) - length(a.t) // 4) || left(b.t, length(a.t) // 4) AS edited
      FROM d a JOIN d b ON b.rn = a.rn % a.n_docs + 1),
sides AS (SELECT rn, 'a' AS side, t FROM e UNION ALL SELECT rn, 'e', edited FROM e),
words AS (SELECT rn, side, t AS text, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ws FROM sides),
lv AS (SELECT rn, side, text, greatest(0, length(bin(len(ws))) - 4) AS lv, ws FROM words),
tm AS (SELECT rn, side, lv, CAST('0x' || left(md5(unnest(ws)), 15) AS BIGINT) AS t FROM lv),
lex AS (SELECT t FROM tm WHERE side = 'a' GROUP BY t HAVING count(*) BETWEEN ceil(pow((SELECT count(*) FROM d), 0.05) - 1e-9) AND floor(pow((SELECT count(*) FROM d), 0.85) + 1e-9)),
kept AS (SELECT rn, side, lv, t FROM tm SEMI JOIN lex USING (t) WHERE t % (CAST(16 AS BIGINT) << lv) < 16),
sig AS (SELECT rn, side, up, t % 16 AS k, left(md5(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t)), 10) AS s FROM kept, range(2) u(up) WHERE t % (CAST(16 AS BIGINT) << CAST(lv + up AS INT)) < 16 GROUP BY ALL),
grid AS (SELECT rn, side, lv, text, CAST(up AS INT) AS up, k FROM lv, range(2) u(up), range(16) g(k)),
fp AS (SELECT rn, side, lv, any_value(text) AS text, list(coalesce(s, '') ORDER BY k) FILTER (up = 0) AS s0, list(coalesce(s, '') ORDER BY k) FILTER (up = 1) AS s1, bool_or(up = 0 AND s IS NOT NULL) AS has
       FROM grid LEFT JOIN sig USING (rn, side, up, k) GROUP BY rn, side, lv),
f AS (SELECT rn, side, CASE WHEN has THEN lv END AS l, s0, s1, CASE WHEN has THEN lv || ':' || array_to_string(s0, ',') || ';' || array_to_string(s1, ',') ELSE '=' || md5(text) END AS fp FROM fp),
two AS (SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint, n.fp AS next_fp,
        CASE b.l - a.l WHEN 0 THEN list_zip(a.s0, b.s0) WHEN 1 THEN list_zip(a.s1, b.s0) WHEN -1 THEN list_zip(a.s0, b.s1) END AS zb,
        CASE n.l - a.l WHEN 0 THEN list_zip(a.s0, n.s0) WHEN 1 THEN list_zip(a.s1, n.s0) WHEN -1 THEN list_zip(a.s0, n.s1) END AS zn
        FROM e JOIN f a ON a.rn = e.rn AND a.side = 'a' JOIN f b ON b.rn = e.rn AND b.side = 'e' JOIN f n ON n.rn = e.next_rn AND n.side = 'a')
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN fingerprint = edited_fingerprint THEN 1.0::DOUBLE ELSE coalesce(len(list_filter(zb, lambda z: z[1] <> '' AND z[1] = z[2]))::DOUBLE / nullif(len(list_filter(zb, lambda z: z[1] <> '' OR z[2] <> '')), 0), 0.0) END AS near_edited,
       CASE WHEN fingerprint = next_fp THEN 1.0::DOUBLE ELSE coalesce(len(list_filter(zn, lambda z: z[1] <> '' AND z[1] = z[2]))::DOUBLE / nullif(len(list_filter(zn, lambda z: z[1] <> '' OR z[2] <> '')), 0), 0.0) END AS near_next
FROM two
"""
