"""Bookkeeping of files: lifecycle joins, roll-ups by run, stream and instance, retention and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import secs

STAGES = ["injected", "new", "copied", "checked", "repacked", "inserted"]
#: Status codes and texts.
STATUS = {-1: "CREATED", 0: "INJECTED", 1: "NEW", 10: "COPIED", 20: "CHECKED", 30: "REPACKED", 35: "INSERTED", 40: "DELETED", 99: "UNKNOWN"}


def files_info(created: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """created left-joined with each stage on the file key, and its status. All joins share the key, so each table shuffles once, and
    not at all when they are bucketed by it."""
    out = created
    for name in STAGES:
        s = stages[name]
        cols = [F.col("file_key")] + [F.col(c).alias(c if c != "itime" else f"t_{name}") for c in s.columns if c != "file_key"]
        out = out.join(s.select(*cols), "file_key", "left")
    out = out.join(stages["deleted"].select("file_key", F.col("dtime").alias("t_deleted")), "file_key", "left")
    return out.withColumn("status", status_code())


def status_code() -> Column:
    """The first missing stage decides; repacked and inserted count only while the file isn't deleted."""
    t = lambda n: F.col(f"t_{n}")
    return (
        F.when(t("injected").isNull(), -1).when(t("new").isNull(), 0).when(t("copied").isNull(), 1).when(t("checked").isNull(), 10)
        .when(t("deleted").isNotNull(), 40).when(t("repacked").isNull(), 20).when(t("inserted").isNull(), 30).otherwise(35)
    )


def status_text(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), code), F.lit(STATUS[99]))


def deletable_files(created: DataFrame, stages: dict[str, DataFrame], now: Column, max_age_s: int, repack_age_s: int, cap: int | None = None) -> DataFrame:
    """Injected and checked files that are not deleted, old enough, and repacked or checked long enough ago; oldest first, cap of them if given."""
    base = created.where(secs(now) - secs("ctime") > max_age_s).join(stages["injected"].select("file_key"), "file_key")
    base = base.join(stages["checked"].select("file_key", F.col("itime").alias("t_checked")), "file_key").join(stages["repacked"].select("file_key", F.col("itime").alias("t_repacked")), "file_key", "left")
    base = base.join(stages["deleted"].select("file_key"), "file_key", "left_anti")
    old = secs(now) - secs(F.coalesce("t_repacked", "t_checked")) > repack_age_s
    out = base.where(old)
    return out.orderBy("ctime", "file_key").limit(cap) if cap else out


def reconcile_inventory(disk: DataFrame, injected: DataFrame, deleted: DataFrame, min_run: int) -> DataFrame:
    """Files on disk against the books by run and instance: n_unaccount = disk - injected + deleted. Both sides are aggregated first."""
    d = disk.where(F.col("runnumber") > min_run).groupBy("runnumber", "instance").agg(F.count("*").alias("n_disk"))
    b = injected.where(F.col("runnumber") > min_run).groupBy("runnumber", "instance").agg(F.count("*").alias("n_injected"))
    x = deleted.where(F.col("runnumber") > min_run).groupBy("runnumber", "instance").agg(F.count("*").alias("n_deleted"))
    j = d.join(b, ["runnumber", "instance"], "full").join(x, ["runnumber", "instance"], "full").na.fill(0, ["n_disk", "n_injected", "n_deleted"])
    return j.withColumn("n_unaccount", F.when(F.col("n_disk") == 0, 0).otherwise(F.col("n_disk") - F.col("n_injected") + F.col("n_deleted")))


def with_run_conditions(files: DataFrame, conditions: DataFrame, names: list[str]) -> DataFrame:
    """files with a column for each named run condition. conditions: runnumber, name, value; a row a run after the pivot."""
    return files.join(conditions.groupBy("runnumber").pivot("name", names).agg(F.min("value")), "runnumber", "left")


def previous_same_label(runs: DataFrame) -> DataFrame:
    """runs (runnumber, setuplabel, n) with n of the latest earlier run of the label."""
    return runs.withColumn("previous_n", F.lag("n").over(Window.partitionBy("setuplabel").orderBy("runnumber")))


def dedupe_files(files: DataFrame, key: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the others."""
    r = files.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return r.where("__r = 1").drop("__r"), r.where("__r > 1").drop("__r")


def orphan_rows(stage: DataFrame, created: DataFrame, key: str = "file_key") -> DataFrame:
    return stage.join(created.select(key), key, "left_anti")


def last_n_runs(df: DataFrame, n: int, run: str = "runnumber") -> DataFrame:
    """Rows of the n newest runs. The runs are a top-n, not a global window, and n rows are broadcast."""
    runs = df.select(run).where(F.col(run).isNotNull()).distinct().orderBy(F.desc(run)).limit(n)
    return df.join(F.broadcast(runs), run, "left_semi")


def rank_instances(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.dense_rank().over(Window.partitionBy("runnumber").orderBy("instance")))


def measures(compat: bool = False) -> dict[str, tuple[str, Column]]:
    """What a row of files_info adds to a roll-up: name to (sum, min or max, value). compat: not-repacked streams by literal name, repacked times from the copies."""
    has = lambda n: F.col(f"t_{n}").isNotNull()
    one = lambda c: F.when(c, F.lit(1)).otherwise(0).cast("long")
    norepack = (F.col("stream") == "Error") | (F.col("stream") == F.lit("%_NoRepack") if compat else F.col("stream").endswith("_NoRepack"))
    own = F.col("producer") == "Logger"
    return {
        "s_created": ("sum", one(own)), "s_lumisection": ("sum", F.when(own, F.col("lumisection"))), "m_instance": ("max", F.when(own, F.col("instance"))), "start_write_time": ("min", F.when(own, F.col("ctime"))),
        "s_injected": ("sum", one(has("injected"))), "s_nevents": ("sum", F.col("nevents")), "s_filesize": ("sum", F.col("filesize")), "stop_write_time": ("max", F.col("t_injected")),
        "hltkey": ("min", F.col("comment_str")), "s_new": ("sum", one(has("new"))), "start_trans_time": ("min", F.col("t_new")), "s_copied": ("sum", one(has("copied"))), "stop_trans_time": ("max", F.col("t_copied")),
        "s_filesize2t0": ("sum", F.when(has("copied"), F.col("filesize"))), "s_checked": ("sum", one(has("checked"))), "s_notrepacked": ("sum", one(has("checked") & norepack)), "start_repack_time": ("min", F.col("t_checked")),
        "s_repacked": ("sum", one(has("repacked"))), "stop_repack_time": ("max", F.col("t_copied" if compat else "t_repacked")), "s_deleted": ("sum", one(has("deleted"))), "hostname": ("min", F.col("hostname")), "setuplabel": ("min", F.col("setuplabel")),
    }


AGGREGATES = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max}


def summary(info: DataFrame, keys: list[str], compat: bool = False) -> DataFrame:
    """All roll-ups of a key in one aggregate over files_info."""
    sums = [AGGREGATES[kind](c).alias(n) for n, (kind, c) in measures(compat).items()]
    return info.groupBy(*keys).agg(*sums, F.countDistinct(F.when(F.col("t_injected").isNotNull(), F.col("instance"))).alias("n_instance"))


def rebuild_summary(info: DataFrame, existing: DataFrame) -> DataFrame:
    """Roll-up of the runs that the summary doesn't have yet."""
    return summary(info.join(existing.select("runnumber").distinct(), "runnumber", "left_anti"), ["runnumber", "stream"])


def rate(info: DataFrame, first: str, last: str, min_state: int) -> DataFrame:
    """MB/s per run between the earliest of one time and the latest of another; -999 where these are equal."""
    f = info.where(F.col("status") > min_state)
    g = f.groupBy("runnumber").agg(F.sum("filesize").alias("b"), (secs(F.max(last)) - secs(F.min(first))).alias("d"))
    return g.select("runnumber", F.when(F.col("d") == 0, -999.0).otherwise(F.round(F.col("b") / 1048576 / F.col("d"), 2)).alias("mb_s"))


def begin_end_of_run(lines: DataFrame) -> DataFrame:
    """Per run and instance: begun, ended, status (1 open, 0 ended), times and lumi count. lines: kind of BoR, EoR, EoLS."""
    k = lambda n: F.col("kind") == n
    return lines.groupBy("run", "instance").agg(
        F.max(k("BoR").cast("int")).alias("begun"), F.max(k("EoR").cast("int")).alias("ended"), F.min(F.when(k("BoR"), F.col("ts"))).alias("start_time"), F.max(F.when(k("EoR"), F.col("ts"))).alias("end_time"), F.countDistinct(F.when(k("EoLS"), F.col("lumi"))).alias("n_lumis")
    ).withColumn("status", F.when(F.col("ended") == 1, 0).otherwise(1))


def bad_lumis(lumis: DataFrame, run: str = "run", lumi: str = "lumi") -> DataFrame:
    """Sections missing below a run's largest one. The spine is bounded by runs times sections."""
    top = lumis.groupBy(run).agg(F.max(lumi).alias("m"))
    spine = top.select(run, F.explode(F.sequence(F.lit(1).cast("long"), F.col("m").cast("long"))).alias(lumi))
    return spine.join(lumis.select(run, F.col(lumi).cast("long").alias(lumi)).distinct(), [run, lumi], "left_anti")


def lumi_consistency(lumis: DataFrame, run: str = "run", lumi: str = "lumi") -> DataFrame:
    """Per run: largest section, last of those without a gap from 1, number missing."""
    bad = bad_lumis(lumis, run, lumi).groupBy(run).agg(F.min(lumi).alias("first_bad"), F.count("*").alias("n_bad"))
    top = lumis.groupBy(run).agg(F.max(lumi).cast("long").alias("max_lumi"))
    return top.join(bad, run, "left").select(run, "max_lumi", F.coalesce(F.col("first_bad") - 1, F.col("max_lumi")).alias("last_good"), F.coalesce("n_bad", F.lit(0)).alias("n_bad"))


def destination(label: Column, stream: Column) -> Column:
    return F.when(label.contains("TransferTest"), "TransferTest").when(stream.rlike("^Error$|_NoRepack$"), "GlobalNoRepacking").otherwise("Global")


def orphan_counts(info: DataFrame, statuses: list[int]) -> DataFrame:
    """Files and MB by host and for all (null), in columns by status."""
    f = info.where(F.col("status").isin(statuses))
    return f.rollup("hostname").agg(*(F.count_if(F.col("status") == s).alias(f"n_{STATUS[s].lower()}") for s in statuses), (F.coalesce(F.sum("filesize"), F.lit(0)) / 1048576).alias("mb"))


def retention_candidates(inventory: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Files older than the age of the highest tier that their folder's fill reaches. inventory: folder, percent, ctime; policy: tier, percent, max_age_s (a small table)."""
    tiers = policy.agg(F.sort_array(F.collect_list(F.struct(F.col("percent").alias("p"), F.col("max_age_s").alias("a")))).alias("t"))
    j = inventory.crossJoin(F.broadcast(tiers)).withColumn("__r", F.filter("t", lambda x: x["p"] <= F.col("percent")))
    return j.where((F.size("__r") > 0) & (secs(now) - secs("ctime") > F.element_at("__r", -1)["a"])).withColumn("limit_s", F.element_at("__r", -1)["a"]).drop("t", "__r")


def max_disk_percent(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """The largest fill over a host's disks, with the host's newest run. samples: host, percent; runs: host, runnumber."""
    return samples.groupBy("host").agg(F.max("percent").alias("disk_full")).join(runs.groupBy("host").agg(F.max("runnumber").alias("runnumber")), "host", "left")


def flags(rows: DataFrame, name: str, flagged: Column, value: Column) -> DataFrame:
    """Per run `` NAME: i(c) j(c)`` of flagged instances in order, blank if none."""
    item = F.when(flagged, F.struct(F.col("instance").alias("i"), F.concat(F.col("instance").cast("string"), F.lit("("), value.cast("string"), F.lit(")")).alias("t")))
    g = rows.groupBy("runnumber").agg(F.sort_array(F.collect_list(item)).alias("x"))
    return g.select("runnumber", F.when(F.size("x") == 0, "").otherwise(F.concat(F.lit(f" {name}: "), F.array_join(F.transform("x", lambda v: v["t"]), " "))).alias("flags"))


def labelled(rows: dict[str, Column], df: DataFrame) -> DataFrame:
    """One-row aggregates as (label, value) rows."""
    one = df.agg(*(c.cast("string").alias(f"c{i}") for i, c in enumerate(rows.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"c{i}").alias("value")) for i, n in enumerate(rows)))).alias("x")).select("x.*")


def with_missing(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
