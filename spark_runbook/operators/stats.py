"""Statistics over time: full and recent quantities, sender and stream roll-ups, alarms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import secs
from .ordered import deal, join_keys, running, scan


def ticks(samples: DataFrame, keys: list[str], ts: str, value: str, tick_s: int = 1) -> DataFrame:
    """Partial sums of each key and tick (aligned to the epoch): t, n, sum, sumsq, min, max."""
    x = F.col(value).cast("double")
    t = F.floor(secs(ts) / tick_s).cast("long")
    return samples.groupBy(*keys, t.alias("t")).agg(F.count(value).alias("n"), F.sum(x).alias("sum"), F.sum(x * x).alias("sumsq"), F.min(x).alias("min"), F.max(x).alias("max"))


def _results(n: Column, s: Column, q: Column, lo: Column, hi: Column, dur: Column) -> list[Column]:
    avg = F.coalesce(F.try_divide(s, n), F.lit(0.0))
    rate = lambda x: F.coalesce(F.try_divide(x, dur), F.lit(0.0))
    return [
        n.alias("n"), s.alias("sum"), avg.alias("avg"), F.sqrt(F.greatest(F.coalesce(F.try_divide(q, n), F.lit(0.0)) - avg * avg, F.lit(0.0))).alias("rms"), lo.alias("min"), hi.alias("max"),
        dur.cast("double").alias("duration"), rate(n).alias("sample_rate"), rate(s).alias("value_rate"),
    ]


def quantity_full(samples: DataFrame, keys: list[str], ts: str, value: str, tick_s: int = 1) -> DataFrame:
    """Count, sum, mean, population RMS, extremes, duration (ticks from the first to the last, empty ones too) and rates of each key."""
    g = ticks(samples, keys, ts, value, tick_s).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "sum", "sumsq")), F.min("min").alias("min"), F.max("max").alias("max"), ((F.max("t") - F.min("t") + 1) * tick_s).alias("d"))
    return g.select(*keys, *_results(*(F.col(c) for c in ("n", "sum", "sumsq", "min", "max", "d"))))


def dense(partials: DataFrame, keys: list[str]) -> DataFrame:
    """partials with a row for every tick from the key's first to its last."""
    spine = partials.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("t"))
    return join_keys(spine, partials, [*keys, "t"], "left").na.fill(0, ["n", "sum", "sumsq"])


def quantity_recent(samples: DataFrame, keys: list[str], ts: str, value: str, tick_s: int, span_s: int) -> DataFrame:
    """The same over the last ticks of the span, at every tick; empty ticks count. Rows are bounded by keys times ticks."""
    n = max(1, round(span_s / tick_s))
    d = dense(ticks(samples, keys, ts, value, tick_s), keys)
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(1 - n, 0)
    d = d.select(*keys, "t", *(F.sum(c).over(w).alias(c) for c in ("n", "sum", "sumsq")), F.min("min").over(w).alias("min"), F.max("max").over(w).alias("max"), (F.count("*").over(w) * tick_s).alias("d"))
    return d.select(*keys, "t", *_results(*(F.col(c) for c in ("n", "sum", "sumsq", "min", "max", "d"))))


def binned_history(samples: DataFrame, keys: list[str], ts: str, value: str, tick_s: int) -> DataFrame:
    return dense(ticks(samples, keys, ts, value, tick_s), keys).select(*keys, "t", "n", "sum", F.lit(float(tick_s)).alias("duration"))


def sample_latency(rate: Column) -> Column:
    """Microseconds between samples; infinite at rate 0."""
    return F.coalesce(F.try_divide(F.lit(1e6), rate), F.lit(float("inf")))


def bandwidth(samples: DataFrame, keys: list[str], ts: str, value: str, tick_s: int) -> DataFrame:
    """Statistics of the per-tick rates of a quantity, from its first sample on."""
    d = dense(ticks(samples, keys, ts, value, tick_s), keys).withColumn("rate", F.col("sum") / tick_s)
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("rate").alias("avg"), F.min("rate").alias("min"), F.max("rate").alias("max"), F.max_by("rate", "t").alias("last"))


def sample_if_larger(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value is above all before (0 at first), by a running maximum over ranges."""
    top = scan(samples, keys, order, __m=("max", F.col(value), False))
    return top.where(F.col(value) > F.coalesce("__m", F.lit(0))).select(*samples.columns)


def sender_stats(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key: events and errors with their bytes, the last run and event."""
    err = F.col("message_code") == "ERROR_EVENT"
    return events.groupBy(*keys).agg(
        F.count_if(~err).alias("n_events"), F.coalesce(F.sum(F.when(~err, F.col("data_size"))), F.lit(0)).alias("event_bytes"), F.count_if(err).alias("n_errors"),
        F.coalesce(F.sum(F.when(err, F.col("data_size"))), F.lit(0)).alias("error_bytes"), F.max_by("run_number", F.struct(*order)).alias("last_run"), F.max_by("event_number", F.struct(*order)).alias("last_event"),
    )


def output_module_stats(events: DataFrame) -> DataFrame:
    """Counts and bytes of modules at three levels: all, by broker, by filter unit; one grouping-sets aggregate."""
    g = events.groupingSets([["output_module_label"], ["output_module_label", "broker_id"], ["output_module_label", "broker_id", "filter_unit"]], "output_module_label", "broker_id", "filter_unit")
    return g.agg(F.grouping_id().alias("level"), F.count("*").alias("n_events"), F.sum("data_size").alias("bytes")).select("output_module_label", "broker_id", "filter_unit", F.when(F.col("level") == 3, 0).when(F.col("level") == 1, 1).otherwise(2).alias("level"), "n_events", "bytes")


def connected_senders(init: DataFrame) -> DataFrame:
    """Per broker the whole quotient of expected senders by INIT messages, and how many. init: broker_id, expected."""
    return init.groupBy("broker_id").agg(F.expr("sum(expected) div count(*)").alias("connected"), F.count("*").alias("n_init"))


def active_senders(events: DataFrame, now: Column, span_s: int = 300) -> DataFrame:
    return events.where((secs(now) - secs("creation_time")).between(0, span_s)).groupBy("broker_id").agg(F.countDistinct("filter_unit").alias("active"))


def outstanding_discards(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Messages less discards by kind. rows: kind of init, event, error, faulty, dqm, discard, dqm_discard."""
    n = lambda *k: F.count_if(F.col("kind").isin(*k))
    return rows.groupBy(*keys).agg((n("init", "event", "error", "faulty") - n("discard")).alias("outstanding"), (n("dqm") - n("dqm_discard")).alias("outstanding_dqm"))


def skipped_discards(discards: DataFrame, brokers: DataFrame, valid: list[int]) -> DataFrame:
    """Discards of an unknown broker or with an invalid code, by kind."""
    known = join_keys(discards, brokers.select("broker_id", F.lit(True).alias("__k")).distinct(), ["broker_id"], "left")
    why = F.when(F.col("__k").isNull(), "unknown_broker").when(~F.col("code").isin(valid), "invalid_code")
    return known.select("kind", why.alias("why")).where("why is not null").groupBy("kind", "why").agg(F.count("*").alias("n"))


def sender_alarms(events: DataFrame, discards: DataFrame, brokers: DataFrame, valid: list[int]) -> DataFrame:
    """Alarms of each broker: raised by any faulty event, and by any discard that is ignored (an unknown broker, or an invalid code), else revoked.
    events: broker_id, faulty; discards: broker_id, code; brokers: the known ones, shown with or without messages."""
    none = F.lit(0).cast("long")
    known = brokers.select("broker_id", F.lit(True).alias("k"), none.alias("f"), none.alias("n"), none.alias("b"))
    bad = (~F.coalesce(F.col("code").isin(valid), F.lit(False))).cast("long")
    rows = known.unionByName(events.select("broker_id", F.lit(False).alias("k"), F.coalesce(F.col("faulty").cast("long"), none).alias("f"), none.alias("n"), none.alias("b"))).unionByName(discards.select("broker_id", F.lit(False).alias("k"), none.alias("f"), F.lit(1).cast("long").alias("n"), bad.alias("b")))
    every = rows.groupBy("broker_id").agg(F.max("k").alias("__k"), F.sum("f").alias("faulty_events"), F.sum("n").alias("__n"), F.sum("b").alias("__bad"))
    ignored = F.coalesce(F.when(F.col("__k"), F.col("__bad")).otherwise(F.col("__n")), F.lit(0))
    n = every.select("broker_id", "faulty_events", ignored.alias("ignored_discards"))
    alarm = lambda c: F.when(F.col(c) > 0, "raise").otherwise("revoke")
    return n.withColumn("faulty_alarm", alarm("faulty_events")).withColumn("ignored_discard_alarm", alarm("ignored_discards"))


def sender_id(*parts: Column) -> Column:
    """CRC-32 of the key's text."""
    return F.crc32(F.concat(*(p.cast("string") for p in parts)).cast("binary"))


def stream_stats(files: DataFrame, stream: str = "stream", size: str = "filesize", seconds: Column | None = None) -> DataFrame:
    """Files, MB and bandwidth for each stream and for all (null)."""
    return files.rollup(stream).agg(F.count("*").alias("n_files"), (F.sum(size) / (1 << 20)).alias("mb"), F.max(size).alias("largest"))


def fragment_stats(fragments: DataFrame, keys: list[str]) -> DataFrame:
    dqm = F.col("code") == 3
    return fragments.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.sum("data_size").alias("bytes"), F.coalesce(F.sum(F.when(~dqm, F.col("data_size"))), F.lit(0)).alias("event_bytes"), F.coalesce(F.sum(F.when(dqm, F.col("data_size"))), F.lit(0)).alias("dqm_bytes"))


def run_stats(events: DataFrame, wanted: Column) -> DataFrame:
    err = F.col("message_code") == "ERROR_EVENT"
    return events.groupBy("run_number").agg(F.count_if(~err).alias("n_events"), F.count_if(err).alias("n_errors"), F.count_if(~err & ~wanted).alias("n_unwanted"), F.countDistinct("lumi_section").alias("n_lumis"), F.max("lumi_section").alias("last_lumi"))


def consumer_stats(queued: DataFrame) -> DataFrame:
    """Rows and bytes of each outcome per consumer and for all (null). queued: consumer, outcome, data_size."""
    return queued.rollup("consumer").agg(F.count_if(F.col("outcome") == "queued").alias("queued"), F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.coalesce(F.sum(F.when(F.col("outcome") == "queued", F.col("data_size"))), F.lit(0)).alias("queued_bytes"))


def throughput_snapshots(samples: DataFrame, metric: str, metrics: list[str], ts: str, value: str, tick_s: int, last_n: int) -> DataFrame:
    """Per tick the rate of each metric, in columns, for the last n ticks."""
    t = F.floor(secs(ts) / tick_s).cast("long")
    wide = samples.groupBy(t.alias("t")).pivot(metric, metrics).agg(F.sum(value) / tick_s)
    last = wide.select("t").orderBy(F.desc("t")).limit(last_n)
    return wide.join(last, "t", "left_semi").na.fill(0.0, metrics)


def busy_percent(n: Column, idle: Column, duration: Column) -> Column:
    return F.when(n == 0, 100.0).when(n == 1, 0.0).when(idle <= duration, 100.0 * (1 - idle / duration)).otherwise(0.0)


def smooth_idle_times(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Idle times longer than their ticks, spread: from the newest back a group grows while its idle time is more than its duration, then each tick gets its
    share by duration. One fold over each key's ticks (a monitor keeps at most some hundred)."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "idle", "duration")), asc=False).alias("x"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("i"), zero.alias("d"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("of"))

    def step(a, r):
        i, d = a["i"] + r["idle"], a["d"] + r["duration"]
        done = i <= d
        return F.struct(F.when(done, zero).otherwise(i).alias("i"), F.when(done, zero).otherwise(d).alias("d"), (a["g"] + done.cast("int")).alias("g"), F.concat(a["of"], F.array(a["g"])).alias("of"))

    flat = g.select(*keys, F.explode(F.arrays_zip(F.col("x"), F.aggregate("x", start, step)["of"].alias("of"))).alias("z")).select(*keys, "z.x.*", "z.of")
    w = Window.partitionBy(*keys, "of")
    return flat.select(*keys, order, "duration", (F.sum("idle").over(w) * F.col("duration") / F.sum("duration").over(w)).alias("idle"))


def unwanted_by_module(unwanted: DataFrame, tick_s: int, threshold: int) -> DataFrame:
    """Unwanted events per module and tick, with alarm: raised when a tick adds more than the threshold, cleared when it adds none."""
    c = unwanted.groupBy("output_module_label", F.floor(secs("creation_time") / tick_s).cast("long").alias("t")).agg(F.count("*").alias("n"))
    return dense_counts(c, ["output_module_label"]).withColumn("alarm", F.when(F.col("n") > threshold, "raise").when(F.col("n") == 0, "clear").otherwise("keep"))


def dense_counts(c: DataFrame, keys: list[str]) -> DataFrame:
    spine = c.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("z")).select(*keys, F.explode(F.sequence("a", "z")).alias("t"))
    return join_keys(spine, c, [*keys, "t"], "left").na.fill(0, ["n"])


def threshold_alarm(n: Column, at_least: int) -> Column:
    return F.when(n >= at_least, "raise").otherwise("clear")


def alarm_transitions(levels: DataFrame, name: str, order: list[str], level: str = "level") -> DataFrame:
    """Rows where an alarm's level changes; the first counts if it isn't OKAY."""
    before = F.coalesce(F.lag(level).over(Window.partitionBy(name).orderBy(*order)), F.lit("OKAY"))
    return levels.withColumn("previous", before).where(F.col(level) != F.col("previous"))


def disk_usage(samples: DataFrame, high: float = 90.0, fail: float = 95.0) -> DataFrame:
    """Percent used and level: WARNING above high, FATAL above fail on important disks; back to OKAY only below 0.95 of high. The level of a row needs only the last row that
    is clearly raised or clearly cleared. samples: path, ts, used, size, important."""
    pct = 100.0 * F.col("used") / F.col("size")
    state = F.when((pct > fail) & F.col("important"), "FATAL").when(pct > high, "WARNING").when(pct < 0.95 * high, "OKAY")
    known = scan(samples.select("path", "ts", pct.alias("percent"), state.alias("__s")), ["path"], ["ts"], level=("last", F.col("__s"), True))
    return known.select("path", "ts", "percent", F.coalesce("level", F.lit("OKAY")).alias("level"))


def worker_status(counts: DataFrame, copy: int, inject: int) -> DataFrame:
    """WARNING for fewer copy workers, or other than the expected inject workers; a negative expectation is none."""
    bad = (F.lit(copy >= 0) & (F.col("copy_workers") < copy)) | (F.lit(inject >= 0) & (F.col("inject_workers") != inject))
    return counts.withColumn("level", F.when(bad, "WARNING").otherwise("OKAY"))


def discard_totals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Served rows with the number dropped since the one served before, by running counts over ranges. rows: outcome of served or dropped."""
    dealt = deal(rows, keys, order)
    drops = running(dealt, keys, __d=("count", F.when(F.col("outcome") == "dropped", 1), True))
    last = running(drops, keys, __b=("max", F.when(F.col("outcome") == "served", F.col("__d")), False))  # drops up to the row served before
    return last.where("outcome = 'served'").select(*rows.columns, (F.col("__d") - F.coalesce("__b", F.lit(0))).alias("dropped_before"))


def output_module_summary(events: DataFrame, to_disk: DataFrame, served: DataFrame, seconds: int) -> DataFrame:
    """Per module mean event KB, rate, input, disk (-1: no stream) and consumer MB/s, and a total row (null)."""
    mb = float(1 << 20) * seconds
    a = events.groupBy("output_module_label").agg(F.sum("data_size").alias("b"), F.count("*").alias("n"))
    d = to_disk.groupBy("output_module_label").agg(F.sum("data_size").alias("disk"))
    c = served.groupBy("output_module_label").agg(F.sum("data_size").alias("cons"))
    j = reduce(lambda x, y: x.join(y, "output_module_label", "left"), [a, d, c])
    g = j.rollup("output_module_label").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.sum("disk").alias("disk"), F.coalesce(F.sum("cons"), F.lit(0)).alias("cons"))
    return g.select("output_module_label", (F.col("b") / F.col("n") / 1024).alias("event_kb"), (F.col("n") / seconds).alias("rate"), (F.col("b") / mb).alias("input_mb_s"), F.coalesce(F.col("disk") / mb, F.lit(-1.0)).alias("disk_mb_s"), (F.col("cons") / mb).alias("consumer_mb_s"))


def consumer_table(consumers: DataFrame, stats: DataFrame, now: Column) -> DataFrame:
    """consumers (name, buffer, last_contact, timeout_s) with age, stale, sharers of the buffer and counts, 0 when none."""
    age = secs(now) - secs("last_contact")
    shared = F.count("*").over(Window.partitionBy("buffer"))
    j = consumers.select("name", "buffer", age.alias("age_s"), (age > F.col("timeout_s")).alias("stale"), shared.alias("sharers")).join(stats.withColumnRenamed("consumer", "name"), "name", "left")
    return j.na.fill(0, [c for c in stats.columns if c != "consumer"])
