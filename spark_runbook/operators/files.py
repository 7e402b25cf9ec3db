"""Events rolled into files by run, lumi section and stream."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import PART, POS, deal, join_keys

GROUP = ["stream", "run_number", "lumi_section"]
#: Why a file was closed.
REASONS = {0: "not closed", 1: "file size", 2: "LS ended", 3: "timeout", 4: "run ended", 5: "truncated", 6: "stop"}


def assign_files(events: DataFrame, max_bytes: Column, order: list[str], size: str = "data_size", header: int = 0, group: list[str] = GROUP, chunks: int | None = None) -> DataFrame:
    """events with file_counter: a file is left when the next event would make it larger than max_bytes (as its first event says) and it isn't empty.

    Where a file ends depends on where it began, so a section looks like one fold. But which event would follow as the next file's first is known for
    every event from running sums (``_next_starts``), and only events near the end of a range lead out of it. So sections of any size are dealt by ranges (``deal``):
    each range finds its ways out, these are searched in the range that they lead to, and the links from way out to way out, a few rows a range, are followed from each
    section's first event by pointer doubling. Then each range marks its own starts. Null keys are groups; a null size counts as nothing."""
    dealt = deal(events.select("*", F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("__s"), max_bytes.cast("long").alias("__m")), group, order, chunks)
    keyed = dealt.select(PART, POS, F.dense_rank().over(Window.partitionBy(PART).orderBy(*group)).alias("__g"), "__s", "__m")
    totals = dealt.groupBy(*group, PART).agg(F.sum("__s").alias("bytes"))
    each = Window.partitionBy(*group).orderBy(PART)
    spans = totals.select(F.min(PART).over(Window.partitionBy(*group)).alias("gid"), F.col(PART).alias("part"), F.coalesce(F.sum("bytes").over(each.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), "bytes", F.count("*").over(Window.partitionBy(*group)).alias("n"))
    rows = sorted((r.gid, r.part, r.base, r.bytes) for r in spans.where("n > 1").collect())  # two rows a range at most: a section that begins before it and one that goes on behind it
    starts = keyed.select(PART, POS, "__g", "__s", "__m")
    if rows:
        where = {}
        for gid, part, base, n_bytes in rows:
            where.setdefault(gid, []).append((part, base, base + n_bytes))
        exits = _cut(starts.groupBy(PART).applyInArrow(lambda t: _ways_out(t, where, header), "gid long, part int, pos long, reach long, to int, first boolean"))
        links = _cut(starts.groupBy(PART).cogroup(exits.groupBy("to")).applyInArrow(lambda t, e: _ways_in(t, e, where, header), "part int, pos long, entry_part int, entry long, next_pos long"))
        entries = _followed(exits.where("first").select("part", "pos"), links)
        marked = starts.groupBy(PART).cogroup(entries.groupBy("entry_part")).applyInArrow(lambda t, e: _marked(t, e, where, header), f"{POS} long, __n long")
    else:
        marked = starts.groupBy(PART).applyInArrow(lambda t: _marked(t, None, {}, header), f"{POS} long, __n long")
    counted = dealt.join(marked, POS)
    whole = counted.groupBy(*group, PART).agg(F.max("__n").alias("n"))
    carry = whole.select(*group, PART, F.sum("n").over(each.rowsBetween(Window.unboundedPreceding, -1)).alias("__before")).where("__before IS NOT NULL")
    out = join_keys(counted, F.broadcast(carry), [*group, PART], "left")  # a row a range at most
    return out.select(*events.columns, (F.col("__n") + F.coalesce("__before", F.lit(0)) - 1).cast("int").alias("file_counter"))


def _cut(df: DataFrame) -> DataFrame:
    from ..streaming.stateful import shared_folder

    df.write.parquet(path := shared_folder(df.sparkSession, "links"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Range:
    """One range's rows in order: for each, its group's bounds, running bytes, and the first event of the file behind one that it begins (the group's end if there is none here)."""

    def __init__(self, table: pa.Table, header: int):
        pos, g, s, m = (table.column(c).to_numpy() for c in (POS, "__g", "__s", "__m"))
        at = np.argsort(pos)
        self.pos, g, self.size, most = pos[at], g[at], s[at], m[at]
        n = len(at)
        first = np.flatnonzero(np.diff(g, prepend=g[0] - 1)) if n else np.zeros(0, np.int64)
        self.bounds = list(zip(first.tolist(), [*first[1:].tolist(), n], strict=True))
        self.sum = np.cumsum(self.size)
        self.reach = self.sum - self.size + most - header  # a file that begins here holds running bytes up to this
        end = np.repeat([b for _, b in self.bounds], [b - a for a, b in self.bounds]) if n else first
        self.next = np.minimum(np.maximum(np.arange(n) + 1, np.searchsorted(self.sum, self.reach, side="right")), end)

    def last(self, a: int, b: int) -> np.ndarray:
        """Of the rows from a to b, the last start of the chain that begins at each (from a on), by doubling."""
        to = self.next[a:b] - a
        stay = to >= b - a
        jump = np.where(stay, np.arange(b - a), to)
        while (jump != (far := jump[jump])).any():
            jump = far
        return jump


def _part_of(table: pa.Table) -> int:
    return table.column(PART)[0].as_py()


def _base(where: dict, gid: int, part: int) -> tuple[int, int]:
    """Bytes of a section before and up to the end of a range."""
    return next((base, end) for p, base, end in where[gid] if p == part)


def _ways_out(table: pa.Table, where: dict, header: int) -> pa.Table:
    """Events of a range's last group after which no file of this range begins: how far their file reaches, and the range that its next one begins in."""
    part, kinds = _part_of(table), {"gid": pa.int64(), "part": pa.int32(), "pos": pa.int64(), "reach": pa.int64(), "to": pa.int32(), "first": pa.bool_()}
    gid = next((g for g, ps in where.items() if any(p == part for p, _, _ in ps[:-1])), None)
    r = _Range(table, header)
    if gid is None:
        return pa.Table.from_pydict({k: [] for k in kinds}, pa.schema(list(kinds.items())))
    a, b = r.bounds[-1]
    before = r.sum[a] - r.size[a]
    base, end = _base(where, gid, part)
    out = a + np.flatnonzero(r.next[a:b] >= b)
    reach = base + r.reach[out] - before
    later = [(p, e) for p, _, e in where[gid] if p > part]
    # the next file begins in the first later range that ends beyond the reach
    k = np.searchsorted([e for _, e in later], np.maximum(reach, end - 1), side="right")
    ok = k < len(later)
    begun = a + r.last(a, b)[0] if gid == part else -1
    out, reach, k = out[ok], reach[ok], k[ok]
    cols = [np.full(len(out), gid), np.full(len(out), part), r.pos[out], reach, np.array([p for p, _ in later], np.int64)[k], out == begun]
    return pa.Table.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def _ways_in(table: pa.Table, exits: pa.Table, where: dict, header: int) -> pa.Table:
    """For each way out that leads to this range: the event that begins the file, and from which event its chain leaves this range again (null: it doesn't)."""
    kinds = {"part": pa.int32(), "pos": pa.int64(), "entry_part": pa.int32(), "entry": pa.int64(), "next_pos": pa.int64()}
    if not exits.num_rows:
        return pa.Table.from_pydict({k: [] for k in kinds}, pa.schema(list(kinds.items())))
    part, r = _part_of(table), _Range(table, header)
    gid = exits.column("gid")[0].as_py()  # a range's first group alone began before it
    a, b = r.bounds[0]
    base, _ = _base(where, gid, part)
    at = np.searchsorted(base + r.sum[a:b], exits.column("reach").to_numpy(), side="right")
    on = part != where[gid][-1][0]
    leave = pa.array(r.pos[a + r.last(a, b)[at]], pa.int64()) if on else pa.nulls(len(at), pa.int64())
    return pa.Table.from_arrays([exits.column("part").combine_chunks(), exits.column("pos").combine_chunks(), pa.array(np.full(len(at), part), pa.int32()), pa.array(r.pos[a + at], pa.int64()), leave], names=list(kinds))


def _followed(reached: DataFrame, links: DataFrame) -> DataFrame:
    """entry_part, entry: the starts that chains from the ways out ``reached`` enter ranges with, by pointer doubling: as many rounds as the logarithm of a section's ranges."""
    step = links.where("next_pos IS NOT NULL").select("part", "pos", F.col("entry_part").alias("to_part"), F.col("next_pos").alias("to_pos"))
    reached, n = _cut(reached), -1
    while n != (now := reached.count()):
        n = now
        more = reached.join(step, ["part", "pos"]).select(F.col("to_part").alias("part"), F.col("to_pos").alias("pos"))
        reached = _cut(reached.union(more).distinct())
        far = step.select(F.col("part").alias("to_part"), F.col("pos").alias("to_pos"), F.col("to_part").alias("far_part"), F.col("to_pos").alias("far_pos"))
        step = _cut(step.join(far, ["to_part", "to_pos"]).select("part", "pos", F.col("far_part").alias("to_part"), F.col("far_pos").alias("to_pos")))
    return links.join(reached, ["part", "pos"], "left_semi").select("entry_part", "entry").distinct()


def _marked(table: pa.Table, entries: pa.Table | None, where: dict, header: int) -> pa.Table:
    """For each event of a range, how many files of its group have begun in the range up to it."""
    r = _Range(table, header)
    start, to = np.zeros(len(r.pos), np.int64), r.next.tolist()
    part = _part_of(table) if table.num_rows else -1
    goes_on = any(p == part for ps in where.values() for p, _, _ in ps[1:])
    for i, (a, b) in enumerate(r.bounds):
        at = a
        if i == 0 and goes_on:
            at = int(np.searchsorted(r.pos, entries.column("entry")[0].as_py())) if entries is not None and entries.num_rows else b
        while at < b:
            start[at] = 1
            at = to[at]
    n = np.cumsum(start)
    for a, b in reversed(r.bounds):
        n[a:b] -= n[a - 1] if a else 0
    return pa.Table.from_arrays([pa.array(r.pos, pa.int64()), pa.array(n, pa.int64())], names=[POS, "__n"])


def core_name(label: str, run: Column, lumi: Column, stream: Column, instance: Column, app: str = "logger") -> Column:
    return F.format_string(f"{label}.%08d.%04d.%s.{app}.%02d", run.cast("long"), lumi.cast("long"), stream, instance.cast("long"))


def file_name(core: Column, counter: Column) -> Column:
    return F.format_string("%s.%04d.dat", core, counter.cast("int"))


def file_counter(files: DataFrame, core: str, order: list[str]) -> DataFrame:
    """0, 1, 2 ... per core name."""
    return files.withColumn("counter", F.dense_rank().over(Window.partitionBy(core).orderBy(*order)) - 1)


def logical_disk(run: Column, instance: Column, entry: Column, disks: int) -> Column:
    """Two digits, blank without disks."""
    return F.format_string("%02d", F.pmod(run + instance + entry, F.lit(disks)).cast("int")) if disks > 0 else F.lit("")


def file_stats(assigned: DataFrame, size: str = "data_size", time: str = "creation_time") -> DataFrame:
    return assigned.groupBy(*GROUP, "file_counter").agg(F.count("*").alias("n_events"), F.sum(size).alias("bytes"), F.min(time).alias("first_entry"), F.max(time).alias("last_entry"))


def closed(stats: DataFrame, eols: DataFrame, now: Column, timeout_s: int = 45) -> DataFrame:
    """stats with closing: a later file of the section (1), the section's end (2), idle longer than the timeout (3; 0: never), else the run's end (4)."""
    from ..functions.times import secs

    last = F.max("file_counter").over(Window.partitionBy(*GROUP))  # files of one section
    ended = eols.select("run_number", "lumi_section", F.lit(True).alias("__eols")).distinct()
    idle = F.lit(timeout_s > 0) & (secs(now) - secs("last_entry") > timeout_s)
    code = F.when(F.col("file_counter") < last, 1).when(F.col("__eols"), 2).when(idle, 3).otherwise(4)
    return join_keys(stats, ended, ["run_number", "lumi_section"], "left").withColumn("closing", code).drop("__eols")


def close_reason(code: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), code), F.lit("unknown"))


def file_path(base: str, is_open: Column, name: Column) -> Column:
    return F.concat(F.lit(base), F.when(is_open, "/open/").otherwise("/closed/"), name)


def size_mismatch(book: Column, disk: Column, tolerance: float, compat: bool = False) -> Column:
    """Whether sizes differ by more than the part given; compat takes the quotient as a whole number."""
    ratio = F.abs(book - disk) / F.greatest(book, disk)
    return F.coalesce((F.floor(ratio) if compat else ratio) > tolerance, F.lit(False))


def lumi_file_counts(files: DataFrame, run: str = "runnumber", lumi: str = "lumisection") -> DataFrame:
    return files.groupBy(run, lumi, "stream").agg(F.count("*").alias("n_files"))


def end_of_lumi_report(files: DataFrame, eols: DataFrame, run: str = "runnumber", lumi: str = "lumisection") -> DataFrame:
    """For each section and stream of its run the file count, 0 when none; eols 1 if the section's end was seen."""
    counts = lumi_file_counts(files, run, lumi)
    spine = join_keys(counts.select(run, lumi).unionByName(eols.select(run, lumi)).distinct(), counts.select(run, "stream").distinct(), [run])
    seen = eols.select(run, lumi, F.lit(1).alias("__e")).distinct()
    every = join_keys(join_keys(spine, counts, [run, lumi, "stream"], "left"), seen, [run, lumi], "left")
    return every.select(run, lumi, "stream", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("__e", F.lit(0)).alias("eols"))


def end_of_run_report(files: DataFrame, eols: DataFrame, run: str = "runnumber", lumi: str = "lumisection") -> DataFrame:
    a = files.groupBy(run).agg(F.countDistinct(lumi).alias("lumis_with_files"), F.max(lumi).alias("last_lumi"))
    e = eols.groupBy(run).agg(F.countDistinct(lumi).alias("eols_count"))
    return join_keys(a, e, [run], "left").withColumn("eols_count", F.coalesce("eols_count", F.lit(0)))


def unreported_lumis(files: DataFrame, reported: DataFrame, run: str = "runnumber", lumi: str = "lumisection") -> DataFrame:
    seen = reported.select(run, lumi, F.lit(True).alias("__seen")).distinct()
    return join_keys(files.select(run, lumi).distinct(), seen, [run, lumi], "left").where("__seen IS NULL").drop("__seen")
