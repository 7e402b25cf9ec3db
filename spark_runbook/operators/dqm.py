"""Mergeable histograms: updates by (run, lumi section, top folder) merged object by object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = ["run_number", "lumi_section", "top_folder"]
OBJECT = [*TOP, "folder", "object_name", "kind"]
UPDATE = ["arrival", "update_number", "sender"]
ORDER = [*UPDATE, "bin", "content"]
BINNED = ("TH1", "TProfile")


def _first(cols: list[str]) -> Column:
    return F.min(F.struct(*cols))


def merge_by_bin(objects: DataFrame, values: list[str]) -> DataFrame:
    """Updates of an object added bin by bin: its first update as it is, later ones only with entries. objects: a row an update and bin, with the sums ``values`` and the entries
    of that bin; an update's entries are those of all its bins. Returns the object, bins (map of bin to a struct of the sums, in order of bins) and entries.

    An update's bins are one row of a histogram's size; sums and first updates are combined before they shuffle, so an object with most updates isn't one task."""
    bins = F.collect_list(F.struct("bin", *values, "entries"))
    updates = objects.groupBy(*OBJECT, *UPDATE).agg(bins.alias("bins"), F.sum("entries").alias("n"))
    first = updates.groupBy(*OBJECT).agg(F.min(F.struct(*UPDATE, "n", "bins")).alias("f"))
    counted = updates.where("n > 0").select(*OBJECT, "bins").unionByName(first.where("coalesce(f.n, 0) <= 0").select(*OBJECT, F.col("f.bins").alias("bins")))
    per = counted.select(*OBJECT, F.explode("bins").alias("b")).select(*OBJECT, "b.*")
    summed = per.groupBy(*OBJECT, "bin").agg(*(F.sum(v).alias(v) for v in values), F.sum("entries").alias("entries"))
    return summed.groupBy(*OBJECT).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bin", F.struct(*values).alias("v"))))).alias("bins"), F.sum("entries").alias("entries"))


def merge_histograms(objects: DataFrame) -> DataFrame:
    """Histograms: contents added by bin. Returns the object, bins (map of bin to content), total and entries."""
    m = merge_by_bin(objects.where("kind = 'TH1'"), ["content"])
    contents = F.transform_values("bins", lambda _, v: v["content"])
    return m.select(*OBJECT, contents.alias("bins"), F.aggregate(F.map_values(contents), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("total"), "entries")


PROFILE = ["w", "wy", "wyy"]


def merge_profiles(objects: DataFrame) -> DataFrame:
    """Profiles: by bin the sums of weights, of weight times y and of weight times y squared (columns w, wy, wyy) are added, and mean and spread follow from them."""
    m = merge_by_bin(objects.where("kind = 'TProfile'"), PROFILE)

    def shown(_, v):
        mean = F.coalesce(F.try_divide(v["wy"].cast("double"), v["w"].cast("double")), F.lit(0.0))
        spread = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(v["wyy"].cast("double"), v["w"].cast("double")), F.lit(0.0)) - mean * mean))
        return F.struct(v["w"].alias("w"), v["wy"].alias("wy"), v["wyy"].alias("wyy"), mean.alias("mean"), spread.alias("spread"))

    return m.select(*OBJECT, F.transform_values("bins", shown).alias("bins"), "entries")


def merge_scalars(objects: DataFrame) -> DataFrame:
    """Other kinds: the first update wins."""
    return objects.where(~F.col("kind").isin(*BINNED)).groupBy(*OBJECT).agg(_first(ORDER).alias("f")).select(*OBJECT, F.col("f.content").alias("content"), F.col("f.update_number").alias("update_number"))


def folder_meta(objects: DataFrame) -> DataFrame:
    """Per top folder: largest update number, first time, merged count, number of updates and of folders."""
    return objects.groupBy(*TOP).agg(
        F.max("update_number").alias("last_update"), F.min("arrival").alias("first_time"), F.max("arrival").alias("last_time"),
        F.sum(F.greatest(F.lit(1), F.col("entries"))).alias("merge_count"), F.countDistinct("sender").alias("n_updates"), F.countDistinct("folder").alias("n_folders"),
    )


def ready(meta: DataFrame, expected: Column, now: Column, ready_s: int = 120) -> DataFrame:
    """meta with ready (as many updates as expected, or none for ready_s) and too_many; nothing is ready without updates."""
    from ..functions.times import secs

    n = F.col("n_updates")
    return meta.withColumn("ready", (n > 0) & ((n == expected) | (secs(now) - secs("last_time") > ready_s))).withColumn("too_many", n > expected)


def collate(objects: DataFrame, merge: bool = True) -> DataFrame:
    """Merged histograms (total: their contents) and profiles (total: their weights) of each key, or each update's objects on their own."""
    binned = objects.where(F.col("kind").isin(*BINNED))
    if not merge:
        return binned.groupBy(*OBJECT, *UPDATE).agg(F.sum("content").alias("total"))
    weights = F.transform(F.map_values("bins"), lambda v: v["w"])
    profiles = merge_profiles(binned).select(*OBJECT, F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0))).alias("total"), "entries")
    return merge_histograms(binned).select(*OBJECT, "total", "entries").unionByName(profiles)


def safe_element_name(xml: Column) -> Column:
    """Name of a scalar written as <name>i=..</name>; other texts as they are."""
    return F.coalesce(F.nullif(F.regexp_extract(xml, r"^<([^>]+)>[a-z]=.*</\1>$", 1), F.lit("")), xml)


def folder_table(objects: DataFrame) -> DataFrame:
    """Each folder's object names in order."""
    return objects.groupBy(*TOP, "folder").agg(F.array_sort(F.collect_set("object_name")).alias("names"))
