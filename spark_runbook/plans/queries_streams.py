"""Queries that run as streams over the tables until all is read (inventory group L and stream forms of others)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.assembly import KEY
from ..streaming import event_time as et, stateful as ss
from .base import QUERIES, SQL
from .views import VIEWS, view, with_views


#: Files of so many bytes are one micro-batch: the number of files doesn't count.
BATCH_BYTES = 256 << 20


def stream(name: str, table: str, sql: str | None = None):
    def wrap(f):
        def run(spark, sf_dir):
            return f(ss.read_table(spark, sf_dir, table, bytes_a_batch=BATCH_BYTES))

        run.__doc__, run.__name__ = f.__doc__, name
        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql)
        return f

    return wrap


def _view(df, name, table):
    return df.sparkSession.sql(VIEWS[name].replace(f"FROM {table}", "FROM {t}"), t=df)


def _epoch(c):
    return F.unix_timestamp(F.col(c).cast("timestamp"))


@stream("l2_tick_window", "events", "SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 AS start_s, count(*) AS n FROM events GROUP BY ALL")
def ticks(ev):
    out = ss.drain(ss.tick_counts(ev, "event_type", "ts", "value", "1 hour"), "complete")
    return out.select("event_type", _epoch("window.start").alias("start_s"), "n")


@stream("l3_sliding_window", "events", "SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) // 3600 * 3600 - 3600 * k AS start_s, count(*) AS n FROM events, range(3) t(k) GROUP BY ALL")
def sliding(ev):
    out = ss.drain(ss.sliding_counts(ev, "event_type", "ts", "3 hours", "1 hour"), "complete")
    return out.select("event_type", _epoch("window.start").alias("start_s"), "n")


@stream("l4_idle_sessions", "events", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(ev):
    out = ss.drain(ss.idle_sessions(ev, "user_id", "ts", "12 hours"), "complete")
    return out.select("user_id", _epoch("session_window.start").alias("start_s"), "n")


#: Files of a table may hold any of its times: rows wait for the end of the table.
ANY_ORDER = "20000 days"

_CHAINS = """o AS (SELECT event_number AS k, row_number() OVER (PARTITION BY code, run_number, event_number, originator_pid, originator_guid, secondary_id ORDER BY arrival, frame_index, num_frames, data_size) AS r, frame_index AS i, num_frames AS nf, data_size AS s, epoch(arrival) AS t FROM fragments),
 f AS (SELECT k, r, t, 0 AS chain, [i] AS seen, s AS size, nf AS total, 0 AS bits, nf = 1 AS done FROM o WHERE r = 1 UNION ALL
       SELECT k, r, t, CASE WHEN new THEN chain + 1 ELSE chain END, CASE WHEN new THEN [i] ELSE list_append(seen, i) END, CASE WHEN new THEN s ELSE size + s END, CASE WHEN new THEN nf ELSE total END, nb,
              CASE WHEN new THEN nf = 1 ELSE len(seen) + 1 = total AND nb = 0 END
       FROM (SELECT o.k, o.r, o.t, o.i, o.s, o.nf, f.chain, f.seen, f.size, f.total, f.done OR o.t - f.t >= 20 * 86400 AS new,
                    CASE WHEN f.done OR o.t - f.t >= 20 * 86400 THEN 0 ELSE f.bits | CASE WHEN o.nf <> f.total THEN 16 ELSE 0 END | CASE WHEN list_contains(f.seen, o.i) THEN 64 ELSE 0 END END AS nb FROM f JOIN o ON o.k = f.k AND o.r = f.r + 1))"""


@stream("l1_assemble_stream", "lineitem", f"WITH RECURSIVE {_CHAINS} SELECT k AS event_number, CAST(len(seen) AS BIGINT) AS n_fragments, CAST(size AS BIGINT) AS event_size, done AS complete, CASE WHEN done THEN 0 ELSE bits | 65664 END AS fault_bits FROM (SELECT *, row_number() OVER (PARTITION BY k, chain ORDER BY r DESC) AS back FROM f) WHERE back = 1")
def assemble(li):
    """Complete events, and those forced out because no fragment came for twenty days of event time or before the run's end."""
    fr = _view(li, "fragments", "lineitem").withColumn("arrival", F.col("arrival").cast("timestamp"))
    out = et.ended(fr, "arrival", ANY_ORDER, lambda m: et.ordered_fold(m, KEY, "arrival", et.Assembly(20 * 86_400_000)))
    return out.select("event_number", "n_fragments", "event_size", "complete", "fault_bits")


@stream("l11_dqm_ready", "lineitem", """WITH g AS (SELECT run_number, lumi_section, top_folder, epoch(arrival) AS t, CASE WHEN epoch(arrival) - lag(epoch(arrival)) OVER w >= 30 * 86400 THEN 1 ELSE 0 END AS new FROM dqm_objects WINDOW w AS (PARTITION BY run_number, lumi_section, top_folder ORDER BY arrival)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY run_number, lumi_section, top_folder ORDER BY t) AS k FROM g)
 SELECT run_number, lumi_section, top_folder, least(count(*), 40) AS n, CASE WHEN count(*) >= 40 THEN 'complete' ELSE 'timeout' END AS reason FROM s GROUP BY run_number, lumi_section, top_folder, k""")
def dqm_ready(li):
    """Ready with forty updates, or thirty days of event time after the last one."""
    up = _view(li, "dqm_objects", "lineitem").withColumn("arrival", F.col("arrival").cast("timestamp")).select("run_number", "lumi_section", "top_folder", "arrival")
    return et.ended(up, "arrival", ANY_ORDER, lambda m: et.ordered_fold(m, ["run_number", "lumi_section", "top_folder"], "arrival", et.Ready(40, 30 * 86_400_000)))


@stream("l7_l10_consumer_buffer", "events")
def buffer(ev):
    """Events fill buffers of ten, purchases poll them; tested against a loop."""
    rows = ev.select(F.concat(F.lit("c"), F.col("user_id") % 4).alias("consumer"), F.when(F.col("event_type") == "purchase", "poll").otherwise("event").alias("kind"), F.col("event_id").alias("seq"), F.col("event_id").alias("event_number"))
    return ss.drain(ss.consumer_buffer(rows, 10), "append")


def expiry(spark, sf_dir):
    """Events that come an hour after their consumer's last poll."""
    ev = view(spark, sf_dir, "daq_events")
    rows = ev.select((F.col("filter_unit") % 16).alias("consumer"), F.when(F.col("s_a") == 1, "poll").otherwise("event").alias("kind"), F.col("event_number").alias("seq"), F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("creation_time")).alias("t"))
    return ss.consumer_expiry(rows, 3600).where("stale AND kind = 'event'").select("consumer", F.col("seq").alias("event_number"))


QUERIES["l8_consumer_expiry"] = expiry
SQL["l8_consumer_expiry"] = with_views("WITH r AS (SELECT filter_unit % 16 AS consumer, event_number, CASE WHEN s_a = 1 THEN 'poll' ELSE 'event' END AS kind, CAST(floor(epoch(creation_time)) AS BIGINT) AS t FROM daq_events), c AS (SELECT *, coalesce(max(CASE WHEN kind = 'poll' THEN t END) OVER (PARTITION BY consumer ORDER BY event_number ROWS UNBOUNDED PRECEDING), min(t) OVER (PARTITION BY consumer)) AS contact FROM r) SELECT consumer, event_number FROM c WHERE t - contact > 3600 AND kind = 'event'")


@stream("l5_drop_old_lumis", "lineitem", "SELECT run_number, count(*) AS n FROM (SELECT *, max(lumi_section) OVER (PARTITION BY run_number ORDER BY arrival, update_number, sender, lumi_section, bin, content ROWS UNBOUNDED PRECEDING) AS m FROM dqm_objects) WHERE lumi_section + 4 >= m GROUP BY 1")
def late(li):
    order = ["arrival", "update_number", "sender", "lumi_section", "bin", "content"]
    up = _view(li, "dqm_objects", "lineitem").withColumn("arrival", F.col("arrival").cast("timestamp")).select("run_number", *order)
    return et.ended(up, "arrival", ANY_ORDER, lambda m: et.DropOldLumis(m, 4, "arrival", order)).groupBy("run_number").agg(F.count("*").alias("n"))


@stream("l6_close_on_lumi_end", "events", "SELECT run_number, lumi_section, output_module_label AS stream, count(*) AS n_events, CAST(sum(data_size) AS BIGINT) AS bytes, 'LS ended' AS reason FROM daq_events WHERE lumi_section % 3 = 0 AND output_module_label <> 'none' GROUP BY ALL")
def punctuated(ev):
    """End rows of every third section, an input of their own, close all streams of their run and section."""
    kind = lambda k: F.lit(k).alias("kind")
    at = F.col("creation_time").cast("timestamp")
    e = _view(ev, "daq_events", "events")
    rows = e.where("output_module_label <> 'none'").select("run_number", "lumi_section", F.col("output_module_label").alias("stream"), kind("event"), "data_size", at.alias("at"))
    end = F.date_trunc("hour", at) + F.expr("INTERVAL 1 HOUR")
    ends = e.where("lumi_section % 3 = 0").select("run_number", "lumi_section", F.lit(None).cast("string").alias("stream"), kind("eols"), F.lit(None).cast("long").alias("data_size"), end.alias("at"))
    streams = ["hltOutputA", "hltOutputB", "PhysicsOModule", "hltOutputDQM"]
    return et.ended(rows.unionByName(ends), "at", ANY_ORDER, lambda m: et.CloseOnLumiEnd(m, streams, "at"))


_BINS = """g AS (SELECT run_number, lumi_section, top_folder, folder, object_name, kind, arrival, update_number, sender, sum(entries) AS n FROM dqm_bins GROUP BY ALL),
 u AS (SELECT *, row_number() OVER (PARTITION BY run_number, lumi_section, top_folder, folder, object_name, kind ORDER BY arrival, update_number, sender) AS r, dense_rank() OVER (PARTITION BY run_number, lumi_section, top_folder ORDER BY arrival, update_number, sender) AS k FROM g)"""


def _folders(li, expected, purge):
    up = _view(li, "dqm_bins", "lineitem").withColumn("arrival", F.col("arrival").cast("timestamp")).withColumn("bin", F.col("bin").cast("long"))
    cols = ["run_number", "lumi_section", "top_folder", "arrival", *et.Collate.columns]
    return et.ended(up.select(*(F.col(c).cast("long").alias(c) if c in ("w", "wy", "wyy", "content", "entries") else c for c in cols)), "arrival", ANY_ORDER, lambda m: et.Collate(m, cols[:3], "arrival", expected, 36_500 * 86_400_000, purge))


@stream("f1_stream_collate", "lineitem", f"WITH {_BINS} SELECT run_number, lumi_section, top_folder, folder, object_name, bin, CAST(sum(content) AS BIGINT) AS content, CAST(sum(w) AS BIGINT) AS w, CAST(sum(wy) AS BIGINT) AS wy, CAST(sum(wyy) AS BIGINT) AS wyy FROM dqm_bins JOIN u USING (run_number, lumi_section, top_folder, folder, object_name, kind, arrival, update_number, sender) WHERE n > 0 OR r = 1 GROUP BY ALL")
def collated(li):
    """All updates of each folder, merged as they come and put out at the run's end."""
    return _folders(li, 1 << 40, False).select("run_number", "lumi_section", "top_folder", "folder", "object_name", "bin", "content", "w", "wy", "wyy")


@stream("f9_stream_purge", "lineitem", f"""WITH {_BINS}, f AS (SELECT run_number, lumi_section, top_folder, max(k) AS k FROM u GROUP BY ALL), b AS (SELECT run_number, lumi_section, top_folder, sum(content) AS total FROM dqm_bins JOIN u USING (run_number, lumi_section, top_folder, folder, object_name, kind, arrival, update_number, sender)
 WHERE u.k <= 12 AND (n > 0 OR r = 1) GROUP BY ALL) SELECT run_number, lumi_section, top_folder, CASE WHEN k >= 12 THEN 'complete' ELSE 'discarded' END AS reason, least(k, 12) AS n, CAST(CASE WHEN k >= 12 THEN total END AS BIGINT) AS total FROM f JOIN b USING (run_number, lumi_section, top_folder)""")
def purged(li):
    """Folders put out with twelve updates; the others are discarded when the run ends."""
    return _folders(li, 12, True).groupBy("run_number", "lumi_section", "top_folder", "reason").agg(F.max(F.least("n", F.lit(12))).alias("n"), F.sum("content").alias("total"))


def log_tail(spark, sf_dir):
    """The file log, tailed: some of its files at first, the others and a second run of the same query from its saved offsets afterwards; parsed as it comes."""
    from ..sources import logs
    from ..sources.tail import LogTail
    from .queries_logs import _file_lines

    spark.dataSource.register(LogTail)
    folder, state, out = (ss.shared_folder(spark, n) for n in ("logs", "state", "stream"))
    lines = _file_lines(view(spark, sf_dir, "files_created"), view(spark, sf_dir, "files_injected"))
    for part in (0, 1):
        lines.where(F.col("file_key") % 3 == 0 if part == 0 else F.col("file_key") % 3 != 0).select("value").write.mode("append").text(folder)
        stream = spark.readStream.format("log_tail").option("rangeBytes", 1 << 20).load(folder)
        parsed = logs.parse_file_log(stream.where("warning IS NULL"), "line")
        parsed.select("action", "args", "rejected").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    a = lambda k: F.element_at("args", k)
    p = spark.read.parquet(out).where("NOT rejected")
    return p.select(a("FILENAME").alias("filename"), a("FILECOUNTER").cast("long").alias("filecounter"), a("NEVENTS").cast("long").alias("nevents"), a("FILESIZE").cast("long").alias("filesize"), a("SETUPLABEL").alias("setuplabel"))


QUERIES["l12_log_tail"] = log_tail
SQL["l12_log_tail"] = with_views("SELECT filename, CAST(file_key % 10 AS BIGINT) AS filecounter, nevents, filesize, setuplabel FROM files_created JOIN files_injected USING (file_key) WHERE file_key % 17 <> 0")
