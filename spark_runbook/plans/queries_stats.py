"""Queries over statistics and alarms (inventory group G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import at, secs
from ..operators import stats
from .base import query
from .queries_events import ROUTED_SQL, routed

_S = "CAST(floor(epoch(creation_time)) AS BIGINT)"
_RES = """n, s AS sum, CASE WHEN n > 0 THEN s / n ELSE 0 END AS avg, sqrt(greatest(CASE WHEN n > 0 THEN q / n - (s / n) * (s / n) ELSE 0 END, 0)) AS rms, lo AS min, hi AS max, CAST(d AS DOUBLE) AS duration, n / d AS sample_rate, s / d AS value_rate"""


def _ticks(keys, tick, value="data_size"):
    return f"tk AS (SELECT {keys}, {_S} // {tick} AS t, count(*) AS n, CAST(sum({value}) AS DOUBLE) AS s, sum(CAST({value} AS DOUBLE) * {value}) AS q, CAST(min({value}) AS DOUBLE) AS lo, CAST(max({value}) AS DOUBLE) AS hi FROM daq_events GROUP BY ALL)"


def _round(df, *cols):
    return df.select(*(F.round(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns))


_FLOATS = ("avg", "rms", "sample_rate", "value_rate")
_RSQL = "n, sum, round(avg, 4) AS avg, round(rms, 4) AS rms, min, max, duration, round(sample_rate, 4) AS sample_rate, round(value_rate, 4) AS value_rate"


@query("g1_quantity_full", f"WITH {_ticks('broker_id', 1)}, g AS (SELECT broker_id, sum(n)::BIGINT AS n, sum(s) AS s, sum(q) AS q, min(lo) AS lo, max(hi) AS hi, max(t) - min(t) + 1 AS d FROM tk GROUP BY 1), r AS (SELECT broker_id, {_RES} FROM g) SELECT broker_id, {_RSQL} FROM r", ev="daq_events")
def full(ev):
    return _round(stats.quantity_full(ev, ["broker_id"], "creation_time", "data_size"), *_FLOATS)


_DENSE = "sp AS (SELECT broker_id, unnest(range(min(t), max(t) + 1)) AS t FROM tk GROUP BY 1), de AS (SELECT sp.broker_id, sp.t, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(q, 0) AS q, lo, hi FROM sp LEFT JOIN tk USING (broker_id, t))"


@query("g2_quantity_recent", f"WITH {_ticks('broker_id', 3600)}, {_DENSE}, g AS (SELECT broker_id, t, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, min(lo) OVER w AS lo, max(hi) OVER w AS hi, count(*) OVER w * 3600 AS d FROM de WINDOW w AS (PARTITION BY broker_id ORDER BY t ROWS 5 PRECEDING)), r AS (SELECT broker_id, t, {_RES} FROM g) SELECT broker_id, t, n::BIGINT AS n, sum, round(avg, 4) AS avg, round(rms, 4) AS rms, min, max, duration, round(sample_rate, 4) AS sample_rate, round(value_rate, 4) AS value_rate FROM r", ev="daq_events")
def recent(ev):
    return _round(stats.quantity_recent(ev, ["broker_id"], "creation_time", "data_size", 3600, 6 * 3600), *_FLOATS)


@query("g3_binned_history", f"WITH {_ticks('broker_id', 3600)}, {_DENSE} SELECT broker_id, t, n::BIGINT AS n, s AS sum, 3600.0::DOUBLE AS duration FROM de", ev="daq_events")
def history(ev):
    return stats.binned_history(ev, ["broker_id"], "creation_time", "data_size", 3600)


@query("g4_sample_latency", f"WITH {_ticks('broker_id', 1)} SELECT broker_id, round(1e6 * (max(t) - min(t) + 1) / sum(n), 2) AS latency_us FROM tk GROUP BY 1", ev="daq_events")
def latency(ev):
    return stats.quantity_full(ev, ["broker_id"], "creation_time", "data_size").select("broker_id", F.round(stats.sample_latency(F.col("sample_rate")), 2).alias("latency_us"))


@query("g5_bandwidth", f"WITH {_ticks('broker_id', 3600)}, {_DENSE} SELECT broker_id, count(*) AS n, round(avg(s / 3600), 5) AS avg, round(min(s / 3600), 5) AS min, round(max(s / 3600), 5) AS max, round(max_by(s / 3600, t), 5) AS last FROM de GROUP BY 1", ev="daq_events")
def bandwidth(ev):
    b = stats.bandwidth(ev, ["broker_id"], "creation_time", "data_size", 3600)
    return b.select("broker_id", "n", *(F.round(c, 5).alias(c) for c in ("avg", "min", "max", "last")))


@query("g6_sample_if_larger", "SELECT broker_id, event_number FROM (SELECT *, coalesce(max(data_size) OVER (PARTITION BY broker_id ORDER BY creation_time, event_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM daq_events) WHERE data_size > m", ev="daq_events")
def larger(ev):
    return stats.sample_if_larger(ev, ["broker_id"], ["creation_time", "event_number"], "data_size").select("broker_id", "event_number")


def _senders(keys):
    return f"SELECT {keys}, count(*) FILTER (message_code <> 'ERROR_EVENT') AS n_events, CAST(coalesce(sum(data_size) FILTER (message_code <> 'ERROR_EVENT'), 0) AS BIGINT) AS event_bytes, count(*) FILTER (message_code = 'ERROR_EVENT') AS n_errors, CAST(coalesce(sum(data_size) FILTER (message_code = 'ERROR_EVENT'), 0) AS BIGINT) AS error_bytes, arg_max(run_number, struct_pack(a := creation_time, b := event_number)) AS last_run, arg_max(event_number, struct_pack(a := creation_time, b := event_number)) AS last_event FROM daq_events GROUP BY {keys}"


for _n, _k in (("g7_sender_stats", ["broker_id"]), ("g8_filter_unit_stats", ["broker_id", "filter_unit"])):
    query(_n, _senders(", ".join(_k)), ev="daq_events")(lambda ev, k=_k: stats.sender_stats(ev, k, ["creation_time", "event_number"]))


@query("g9_output_module_stats", "SELECT output_module_label, broker_id, filter_unit, CASE WHEN grouping(filter_unit) = 0 THEN 2 WHEN grouping(broker_id) = 0 THEN 1 ELSE 0 END AS level, count(*) AS n_events, CAST(sum(data_size) AS BIGINT) AS bytes FROM daq_events GROUP BY GROUPING SETS ((output_module_label), (output_module_label, broker_id), (output_module_label, broker_id, filter_unit))", ev="daq_events")
def modules(ev):
    return stats.output_module_stats(ev)


@query("g10_connected_senders", "SELECT broker_id, sum(expected) // count(*) AS connected, count(*) AS n_init FROM (SELECT broker_id, output_module_id, max(2 + broker_id % 2) AS expected FROM daq_events GROUP BY ALL) GROUP BY 1".replace("sum(expected) // count(*)", "CAST(sum(expected) // count(*) AS BIGINT)"), ev="daq_events")
def connected(ev):
    return stats.connected_senders(ev.groupBy("broker_id", "output_module_id").agg(F.max(2 + F.col("broker_id") % 2).alias("expected")))


@query("g10_active_senders", "SELECT broker_id, count(DISTINCT filter_unit) AS active FROM daq_events WHERE epoch(TIMESTAMP '2024-01-16 00:00:00') - floor(epoch(creation_time)) BETWEEN 0 AND 86400 GROUP BY 1", ev="daq_events")
def active(ev):
    return stats.active_senders(ev, at("2024-01-16 00:00:00"), 86400)


_KINDS = "CASE WHEN event_number % 11 = 0 THEN 'discard' WHEN event_number % 13 = 0 THEN 'dqm_discard' WHEN event_number % 5 = 0 THEN 'dqm' WHEN message_code = 'ERROR_EVENT' THEN 'error' ELSE 'event' END"


@query("g11_outstanding_discards", f"SELECT broker_id, count(*) FILTER (k IN ('event', 'error')) - count(*) FILTER (k = 'discard') AS outstanding, count(*) FILTER (k = 'dqm') - count(*) FILTER (k = 'dqm_discard') AS outstanding_dqm FROM (SELECT *, {_KINDS} AS k FROM daq_events) GROUP BY 1", ev="daq_events")
def outstanding(ev):
    return stats.outstanding_discards(ev.withColumn("kind", F.expr(_KINDS)), ["broker_id"])


@query("g12_skipped_discards", "SELECT message_code AS kind, CASE WHEN filter_unit % 9 = 8 THEN 'unknown_broker' WHEN event_number % 6 NOT IN (0, 1, 2, 3) THEN 'invalid_code' END AS why, count(*) AS n FROM daq_events WHERE filter_unit % 9 = 8 OR event_number % 6 NOT IN (0, 1, 2, 3) GROUP BY ALL", ev="daq_events", se="senders")
def skipped(ev, se):
    d = ev.select((F.col("filter_unit") % 9).alias("broker_id"), (F.col("event_number") % 6).alias("code"), F.col("message_code").alias("kind"))
    return stats.skipped_discards(d, se, [0, 1, 2, 3])


_CRC = """WITH t AS (SELECT DISTINCT broker_id, filter_unit, 'broker' || broker_id || filter_unit AS s FROM daq_events),
 st AS (SELECT *, flatten(list_transform(range(1, length(s) + 1), lambda j: [CAST(ascii(substr(s, j, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM t)
 SELECT broker_id, filter_unit, CAST(xor(list_reduce(list_concat([4294967295], ops), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS BIGINT) AS sender_id FROM st"""


@query("g13_sender_id", _CRC, ev="daq_events")
def sender_ids(ev):
    return ev.select("broker_id", "filter_unit").distinct().withColumn("sender_id", stats.sender_id(F.lit("broker"), F.col("broker_id"), F.col("filter_unit")))


@query("g14_stream_stats", "SELECT stream, count(*) AS n_files, round(sum(filesize) / 1048576, 4) AS mb, max(filesize) AS largest FROM files_created JOIN files_injected USING (file_key) GROUP BY ROLLUP (stream)", fc="files_created", fi="files_injected")
def streams(fc, fi):
    s = stats.stream_stats(fc.select("file_key", "stream").join(fi.select("file_key", "filesize"), "file_key"))
    return s.select("stream", "n_files", F.round("mb", 4).alias("mb"), "largest")


@query("g15_fragment_stats", "SELECT run_number, count(*) AS n_frames, CAST(sum(data_size) AS BIGINT) AS bytes, CAST(coalesce(sum(data_size) FILTER (c <> 3), 0) AS BIGINT) AS event_bytes, CAST(coalesce(sum(data_size) FILTER (c = 3), 0) AS BIGINT) AS dqm_bytes FROM (SELECT *, 1 + 2 * (event_number % 2) AS c FROM fragments) GROUP BY 1", fr="fragments")
def fragments(fr):
    return stats.fragment_stats(fr.withColumn("code", 1 + 2 * (F.col("event_number") % 2)), ["run_number"])


@query("g16_run_stats", "SELECT run_number, count(*) FILTER (message_code <> 'ERROR_EVENT') AS n_events, count(*) FILTER (message_code = 'ERROR_EVENT') AS n_errors, count(*) FILTER (message_code <> 'ERROR_EVENT' AND s_a <> 1) AS n_unwanted, count(DISTINCT lumi_section) AS n_lumis, max(lumi_section) AS last_lumi FROM daq_events GROUP BY 1", ev="daq_events")
def runs(ev):
    return stats.run_stats(ev, F.col("s_a") == 1)


_Q = "q AS (SELECT CAST(filter_unit % 4 AS VARCHAR) AS consumer, CASE WHEN event_number % 3 = 0 THEN 'dropped' ELSE 'queued' END AS outcome, data_size FROM daq_events)"


def _queued(ev):
    return ev.select((F.col("filter_unit") % 4).cast("string").alias("consumer"), F.when(F.col("event_number") % 3 == 0, "dropped").otherwise("queued").alias("outcome"), "data_size")


@query("g17_consumer_stats", f"WITH {_Q} SELECT consumer, count(*) FILTER (outcome = 'queued') AS queued, count(*) FILTER (outcome = 'dropped') AS dropped, CAST(sum(data_size) FILTER (outcome = 'queued') AS BIGINT) AS queued_bytes FROM q GROUP BY ROLLUP (consumer)", ev="daq_events")
def consumer(ev):
    return stats.consumer_stats(_queued(ev))


@query("g18_throughput_snapshots", f"WITH t AS (SELECT {_S} // 3600 AS t, event_type, data_size FROM (SELECT *, message_code AS event_type FROM daq_events)), l AS (SELECT DISTINCT t FROM t ORDER BY t DESC LIMIT 20) SELECT t, round(coalesce(sum(data_size) FILTER (event_type = 'EVENT'), 0) / 3600, 5) AS \"EVENT\", round(coalesce(sum(data_size) FILTER (event_type = 'ERROR_EVENT'), 0) / 3600, 5) AS \"ERROR_EVENT\" FROM t WHERE t IN (SELECT t FROM l) GROUP BY 1", ev="daq_events")
def throughput(ev):
    s = stats.throughput_snapshots(ev, "message_code", ["EVENT", "ERROR_EVENT"], "creation_time", "data_size", 3600, 20)
    return s.select("t", F.round("EVENT", 5).alias("EVENT"), F.round("ERROR_EVENT", 5).alias("ERROR_EVENT"))


@query("g19_busy_percent", "SELECT event_number, CASE s_a WHEN 0 THEN 100.0 WHEN 1 THEN 0.0 ELSE CASE WHEN data_size <= 50000 THEN round(100.0 * (1 - data_size / 50000), 6) ELSE 0.0 END END::DOUBLE AS busy FROM daq_events", ev="daq_events")
def busy(ev):
    return ev.select("event_number", F.round(stats.busy_percent(F.col("s_a"), F.col("data_size"), F.lit(50000)), 6).alias("busy"))


_SMOOTH = """WITH RECURSIVE t AS (SELECT broker_id, run_number * 100 + lumi_section AS tick, sum(data_size) / 1000.0 AS idle FROM daq_events GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY broker_id ORDER BY tick DESC) AS r FROM t),
 f AS (SELECT broker_id, tick, idle, r, idle AS i, 400.0::DOUBLE AS d, 0 AS g FROM o WHERE r = 1 UNION ALL
       SELECT o.broker_id, o.tick, o.idle, o.r, CASE WHEN f.i <= f.d THEN o.idle ELSE f.i + o.idle END, CASE WHEN f.i <= f.d THEN 400.0 ELSE f.d + 400.0 END, CASE WHEN f.i <= f.d THEN f.g + 1 ELSE f.g END FROM f JOIN o ON o.broker_id = f.broker_id AND o.r = f.r + 1)
 SELECT broker_id, tick, 400.0::DOUBLE AS duration, round(avg(idle) OVER (PARTITION BY broker_id, g), 4) AS idle FROM f"""


@query("g20_smooth_idle_times", _SMOOTH, ev="daq_events")
def smooth(ev):
    """Idle times of all ticks (sections of runs) of each broker; a fold."""
    t = ev.groupBy("broker_id", (F.col("run_number") * 100 + F.col("lumi_section")).alias("tick")).agg((F.sum("data_size") / 1000.0).alias("idle"))
    return stats.smooth_idle_times(t.withColumn("duration", F.lit(400.0)), ["broker_id"], "tick").withColumn("idle", F.round("idle", 4))


@query("g21_unwanted_by_module", f"WITH c AS (SELECT output_module_label, {_S} // 86400 AS t, count(*) AS n FROM daq_events WHERE s_a <> 1 GROUP BY ALL), sp AS (SELECT output_module_label, unnest(range(min(t), max(t) + 1)) AS t FROM c GROUP BY 1), d AS (SELECT output_module_label, t, coalesce(n, 0) AS n FROM sp LEFT JOIN c USING (output_module_label, t)) SELECT output_module_label, t, n, CASE WHEN n > 6 THEN 'raise' WHEN n = 0 THEN 'clear' ELSE 'keep' END AS alarm FROM d", ev="daq_events")
def unwanted(ev):
    return stats.unwanted_by_module(ev.where("s_a <> 1"), 86400, 6)


@query("g22_error_event_alarm", f"WITH c AS (SELECT broker_id, {_S} // 86400 AS t, count(*) AS n FROM daq_events WHERE message_code = 'ERROR_EVENT' GROUP BY ALL) SELECT broker_id, t, CASE WHEN n >= 2 THEN 'raise' ELSE 'clear' END AS alarm FROM c", ev="daq_events")
def error_alarm(ev):
    c = ev.where("message_code = 'ERROR_EVENT'").groupBy("broker_id", F.floor(secs("creation_time") / 86400).cast("long").alias("t")).agg(F.count("*").alias("n"))
    return c.select("broker_id", "t", stats.threshold_alarm(F.col("n"), 2).alias("alarm"))


@query("g23_faulty_alarm", "SELECT run_number FROM (SELECT run_number, count(*) AS n FROM daq_events WHERE message_code = 'ERROR_EVENT' GROUP BY 1) WHERE n > 0", ev="daq_events")
def faulty_alarm(ev):
    return ev.where("message_code = 'ERROR_EVENT'").groupBy("run_number").agg(F.count("*").alias("n")).where("n > 0").select("run_number")


_FAULTY = "message_code = 'ERROR_EVENT' AND broker_id % 3 = 0"
_CODE = "CASE WHEN filter_unit % 9 IN (2, 5) AND event_number % 6 = 5 THEN 9 ELSE event_number % 4 END"


@query("g23_sender_alarms", f"WITH f AS (SELECT broker_id, count(*) FILTER ({_FAULTY}) AS n FROM daq_events GROUP BY 1), d AS (SELECT broker_id, count(*) FILTER (broker_id NOT IN (SELECT broker_id FROM senders) OR code NOT IN (0, 1, 2, 3)) AS n FROM (SELECT filter_unit % 9 AS broker_id, {_CODE} AS code FROM daq_events) GROUP BY 1), a AS (SELECT broker_id FROM senders UNION SELECT broker_id FROM f UNION SELECT broker_id FROM d) SELECT broker_id, coalesce(f.n, 0) AS faulty_events, coalesce(d.n, 0) AS ignored_discards, CASE WHEN f.n > 0 THEN 'raise' ELSE 'revoke' END AS faulty_alarm, CASE WHEN d.n > 0 THEN 'raise' ELSE 'revoke' END AS ignored_discard_alarm FROM a LEFT JOIN f USING (broker_id) LEFT JOIN d USING (broker_id)", ev="daq_events", se="senders")
def sender_alarms(ev, se):
    discards = ev.select((F.col("filter_unit") % 9).alias("broker_id"), F.expr(_CODE).alias("code"))
    return stats.sender_alarms(ev.withColumn("faulty", F.expr(_FAULTY)), discards, se, [0, 1, 2, 3])


@query("g24_alarm_state", "SELECT broker_id, event_number, level, previous FROM (SELECT *, coalesce(lag(level) OVER (PARTITION BY broker_id ORDER BY creation_time, event_number), 'OKAY') AS previous FROM (SELECT *, CASE WHEN data_size > 60000 THEN 'FATAL' WHEN data_size > 30000 THEN 'WARNING' ELSE 'OKAY' END AS level FROM daq_events)) WHERE level <> previous", ev="daq_events")
def alarms(ev):
    lv = ev.withColumn("level", F.when(F.col("data_size") > 60000, "FATAL").when(F.col("data_size") > 30000, "WARNING").otherwise("OKAY"))
    return stats.alarm_transitions(lv, "broker_id", ["creation_time", "event_number"]).select("broker_id", "event_number", "level", "previous")


@query("g25_disk_usage", "WITH s AS (SELECT broker_id AS path, event_number, creation_time, CAST(event_number * 37 % 1000 AS DOUBLE) / 10 AS pct, broker_id % 2 = 0 AS important FROM daq_events), k AS (SELECT *, CASE WHEN pct > 95 AND important THEN 'FATAL' WHEN pct > 90 THEN 'WARNING' WHEN pct < 85.5 THEN 'OKAY' END AS st FROM s) SELECT path, event_number, round(pct, 6) AS percent, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY path ORDER BY event_number ROWS UNBOUNDED PRECEDING), 'OKAY') AS level FROM k", ev="daq_events")
def disk(ev):
    s = ev.select(F.col("broker_id").alias("path"), F.col("event_number").alias("ts"), (F.col("event_number") * 37 % 1000).cast("double").alias("used"), F.lit(1000.0).alias("size"), (F.col("broker_id") % 2 == 0).alias("important"))
    return stats.disk_usage(s).select("path", F.col("ts").alias("event_number"), F.round("percent", 6).alias("percent"), "level")


@query("g26_worker_count_status", "SELECT hostname, CASE WHEN c < 60 OR i <> 70 THEN 'WARNING' ELSE 'OKAY' END AS level FROM (SELECT hostname, count(*) AS c, count(*) FILTER (producer = 'Logger') AS i FROM files_created GROUP BY 1)", fc="files_created")
def workers(fc):
    c = fc.groupBy("hostname").agg(F.count("*").alias("copy_workers"), F.count_if(F.col("producer") == "Logger").alias("inject_workers"))
    return stats.worker_status(c, 60, 70).select("hostname", "level")


@query("g27_discard_totals", "WITH o AS (SELECT broker_id, event_number, creation_time, CASE WHEN s_b = 1 THEN 'served' ELSE 'dropped' END AS outcome FROM daq_events), g AS (SELECT *, sum(CASE WHEN outcome = 'served' THEN 1 ELSE 0 END) OVER (PARTITION BY broker_id ORDER BY creation_time, event_number ROWS UNBOUNDED PRECEDING) - CASE WHEN outcome = 'served' THEN 1 ELSE 0 END AS g FROM o) SELECT broker_id, event_number, dropped_before FROM (SELECT *, count(*) FILTER (outcome = 'dropped') OVER (PARTITION BY broker_id, g) AS dropped_before FROM g) WHERE outcome = 'served'", ev="daq_events")
def discards(ev):
    o = ev.withColumn("outcome", F.when(F.col("s_b") == 1, "served").otherwise("dropped"))
    return stats.discard_totals(o, ["broker_id"], ["creation_time", "event_number"]).select("broker_id", "event_number", "dropped_before")


@query("g28_output_module_summary", f"WITH {ROUTED_SQL}, a AS (SELECT output_module_label, sum(data_size) AS b, count(*) AS n FROM daq_events GROUP BY 1), d AS (SELECT output_module_label, sum(data_size) AS disk FROM routed GROUP BY 1), c AS (SELECT output_module_label, sum(data_size) AS cons FROM daq_events WHERE s_c = 1 GROUP BY 1), j AS (SELECT * FROM a LEFT JOIN d USING (output_module_label) LEFT JOIN c USING (output_module_label)) SELECT output_module_label, round(sum(b) / sum(n) / 1024, 4) AS event_kb, round(sum(n) / 2592000, 8) AS rate, round(sum(b) / 2717908992000, 10) AS input_mb_s, round(coalesce(sum(disk) / 2717908992000, -1), 10) AS disk_mb_s, round(coalesce(sum(cons), 0) / 2717908992000, 10) AS consumer_mb_s FROM j GROUP BY ROLLUP (output_module_label)", ev="daq_events")
def module_summary(ev):
    s = stats.output_module_summary(ev, routed(ev), ev.where("s_c = 1"), 2592000)
    return s.select("output_module_label", F.round("event_kb", 4).alias("event_kb"), F.round("rate", 8).alias("rate"), *(F.round(c, 10).alias(c) for c in ("input_mb_s", "disk_mb_s", "consumer_mb_s")))


@query("g29_consumer_table", f"WITH {_Q}, l AS (SELECT CAST(filter_unit % 4 AS VARCHAR) AS name, max(creation_time) AS z FROM daq_events GROUP BY 1), s AS (SELECT consumer, count(*) FILTER (outcome = 'queued') AS queued, count(*) FILTER (outcome = 'dropped') AS dropped, CAST(sum(data_size) FILTER (outcome = 'queued') AS BIGINT) AS queued_bytes FROM q GROUP BY 1) SELECT name, CASE WHEN name < '2' THEN 'x' ELSE 'y' END AS buffer, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(z)) AS BIGINT) AS age_s, epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(z)) > 60 AS stale, CAST(2 AS BIGINT) AS sharers, queued, dropped, queued_bytes FROM l JOIN s ON s.consumer = l.name", ev="daq_events")
def table(ev):
    c = ev.groupBy((F.col("filter_unit") % 4).cast("string").alias("name")).agg(F.max("creation_time").alias("last_contact"))
    c = c.withColumn("buffer", F.when(F.col("name") < "2", "x").otherwise("y")).withColumn("timeout_s", F.lit(60))
    return stats.consumer_table(c, stats.consumer_stats(_queued(ev)).where("consumer is not null"), at("2024-01-31 00:00:00"))
