"""Queries over events, fragments, rolled files and histograms (inventory groups A, B, C1-C3, D, E, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import status
from ..functions.times import at, secs
from ..operators import assembly, dqm, files, selection as sel
from .base import query

NAMES = list("abcdefghi")
#: One stream of each kind of rule: all of a module, a path list, an expression with a sample, a wildcard.
STREAMS = [
    sel.Stream("A", "hltOutputDQM"), sel.Stream("B", "PhysicsOModule", paths=["a", "c", "e", "g", "i"]), sel.Stream("C", "PhysicsOModule", "(a && !b) || c", fraction=0.5, max_mb=512), sel.Stream("D", "hltOutputA", paths=["*"]),
]
CONSUMERS = [sel.Consumer("c1", "hltOutputA", paths=["a", "b"]), sel.Consumer("c2", "hltOutputA", "!a && (d || e*)", prescale=2), sel.Consumer("c3", "hltOutputB", prescale=5, unique=True), sel.Consumer("c4", "hltOutputB", prescale=5, unique=True)]
ORDER = ["creation_time", "event_number"]



def states():
    return F.array(*(f"s_{n}" for n in NAMES))


def key():
    return F.col("event_number") * 7919


_TAGGED = """CASE WHEN output_module_label = 'hltOutputDQM' THEN 'A' END, CASE WHEN output_module_label = 'PhysicsOModule' AND (s_a = 1 OR s_c = 1 OR s_e = 1 OR s_g = 1 OR s_i = 1) THEN 'B' END,
 CASE WHEN output_module_label = 'PhysicsOModule' AND ((s_a = 1 AND NOT s_b = 1) OR s_c = 1) AND (event_number * 7919) % 1000000 < 500000 THEN 'C' END, CASE WHEN output_module_label = 'hltOutputA' THEN 'D' END"""
ROUTED_SQL = f"routed AS (SELECT * FROM (SELECT *, unnest([{_TAGGED}]) AS stream FROM daq_events WHERE message_code = 'EVENT') WHERE stream IS NOT NULL)"


def routed(ev):
    return sel.route_to_streams(ev.where("message_code = 'EVENT'"), STREAMS, NAMES, states(), F.col("output_module_label"), key())


@query("a2_classify_message", "SELECT CASE message_code WHEN 'EVENT' THEN 'DATA' WHEN 'ERROR_EVENT' THEN 'ERROR' ELSE 'FAULTY' END AS kind, count(*) AS n FROM daq_events GROUP BY 1", ev="daq_events")
def classify(ev):
    return ev.groupBy(sel.classify_message(F.col("message_code")).alias("kind")).agg(F.count("*").alias("n"))


@query("b1_trigger_expr", "SELECT event_number FROM daq_events WHERE ((s_a = 1 AND NOT s_b = 1) OR s_c = 1) AND NOT (s_d = 1 OR s_e = 1)", ev="daq_events")
def trigger(ev):
    return ev.where(sel.trigger_expr("((a && !b) || c) && !(d .OR. e)", NAMES, states())).select("event_number")


@query("b2_missing_names", "SELECT event_number FROM daq_events WHERE s_a = 1", ev="daq_events")
def missing(ev):
    return ev.where(sel.trigger_expr("a && !missing", NAMES, states())).select("event_number")


@query("b3_match_triggers", "SELECT event_number FROM daq_events WHERE s_a = 1 OR s_b = 1 OR s_c = 1 OR s_d = 1 OR s_e = 1 OR s_f = 1 OR s_g = 1 OR s_h = 1 OR s_i = 1", ev="daq_events")
def wildcard(ev):
    return ev.where(sel.trigger_expr("?", NAMES, states())).select("event_number")


@query("b4_select_events", "SELECT event_number, output_module_label FROM daq_events WHERE s_a = 1 OR s_c = 1 OR NOT s_g = 1", ev="daq_events")
def selected(ev):
    return ev.where(sel.select_events(["a", "c", "!g"], NAMES, states())).select("event_number", "output_module_label")


@query("b5_decode_trigger_bits", "SELECT event_number, s_a, s_e, s_i FROM daq_events", ev="daq_events")
def bits(ev):
    packed = [sum((F.col(f"s_{n}").cast("int") * 4**j for j, n in enumerate(NAMES[k : k + 4])), F.lit(0)) for k in (0, 4, 8)]
    b = F.unhex(F.concat(*(F.lpad(F.hex(p.cast("long")), 2, "0") for p in packed)))
    d = sel.decode_trigger_bits(b, len(NAMES))
    return ev.select("event_number", d.alias("d")).select("event_number", *(F.col("d")[NAMES.index(n)].alias(f"s_{n}") for n in "aei"))


@query("b6_by_output_module", "SELECT event_number, data_size FROM daq_events WHERE output_module_label = 'PhysicsOModule'", ev="daq_events", init="init_messages")
def module(ev, init):
    return ev.drop("output_module_label").join(F.broadcast(init.where("label = 'PhysicsOModule'")), "output_module_id").select("event_number", "data_size")


@query("b7_fraction_to_disk", "SELECT event_number FROM daq_events WHERE (event_number * 7919) % 1000000 < 250000", ev="daq_events")
def sampled(ev):
    return ev.where(sel.fraction_to_disk(0.25, key())).select("event_number")


@query("b8_prescale", "SELECT output_module_label, event_number FROM (SELECT *, row_number() OVER (PARTITION BY output_module_label ORDER BY creation_time, event_number) AS r FROM daq_events WHERE s_a = 1) WHERE r % 5 = 0", ev="daq_events")
def prescaled(ev):
    return sel.prescale(ev.where("s_a = 1").select("output_module_label", *ORDER), 5, ["output_module_label"], ORDER).select("output_module_label", "event_number")


@query("b9_route_to_streams", f"WITH {ROUTED_SQL} SELECT event_number, stream FROM routed", ev="daq_events")
def route(ev):
    return routed(ev).select("event_number", "stream")


@query("b9_stream_volume", f"WITH {ROUTED_SQL} SELECT stream, run_number, lumi_section, count(*) AS n_events, CAST(sum(data_size) AS BIGINT) AS bytes FROM routed GROUP BY ALL", ev="daq_events")
def volume(ev):
    """Events and bytes per stream, run and lumi section."""
    return routed(ev).groupBy("stream", "run_number", "lumi_section").agg(F.count("*").alias("n_events"), F.sum("data_size").alias("bytes"))


CONS_SQL = """routed AS (SELECT *, unnest(list_filter([CASE WHEN output_module_label = 'hltOutputA' AND (s_a = 1 OR s_b = 1) THEN 'c1' END, CASE WHEN output_module_label = 'hltOutputA' AND NOT s_a = 1 AND (s_d = 1 OR s_e = 1) THEN 'c2' END,
 CASE WHEN output_module_label = 'hltOutputB' THEN 'c3' END, CASE WHEN output_module_label = 'hltOutputB' THEN 'c4' END], lambda x: x IS NOT NULL)) AS consumer FROM daq_events)"""


@query("b10_route_to_consumers", f"WITH {CONS_SQL} SELECT consumer, count(*) AS n, CAST(sum(event_number) AS BIGINT) AS s FROM routed GROUP BY 1", ev="daq_events")
def consumers(ev):
    return sel.route_to_consumers(ev, CONSUMERS, NAMES, states(), F.col("output_module_label")).groupBy("consumer").agg(F.count("*").alias("n"), F.sum("event_number").alias("s"))


@query("b11_route_error_events", "SELECT event_number, s AS stream FROM daq_events, (VALUES ('Error'), ('ErrorCopy')) t(s) WHERE message_code = 'ERROR_EVENT'", ev="daq_events")
def errors(ev):
    return ev.where("message_code = 'ERROR_EVENT'").select("event_number", F.explode(F.array(F.lit("Error"), F.lit("ErrorCopy"))).alias("stream"))


DQM_CONS = "(VALUES ('all', '*', TIMESTAMP '1998-12-01 00:00:00'), ('onlyA', 'A', TIMESTAMP '1998-12-01 00:00:00'), ('late', 'R', TIMESTAMP '1998-01-01 00:00:00')) c(name, folder, last_contact)"


def _dqm_consumers(spark):
    return spark.sql("SELECT * FROM VALUES ('all', '*', TIMESTAMP '1998-12-01 00:00:00', 86400), ('onlyA', 'A', TIMESTAMP '1998-12-01 00:00:00', 86400), ('late', 'R', TIMESTAMP '1998-01-01 00:00:00', 86400) AS c(name, folder, last_contact, timeout_s)")


@query("b12_route_dqm", f"SELECT top_folder, name AS consumer, count(*) AS n FROM dqm_objects, {DQM_CONS} WHERE (folder_ = '*' OR folder_ = top_folder) AND last_contact > TIMESTAMP '1998-06-01 00:00:00' GROUP BY ALL".replace("c(name, folder,", "c(name, folder_,"), ob="dqm_objects")
def dqm_route(ob):
    return sel.route_dqm(ob.groupBy("top_folder").agg(F.count("*").alias("n")), _dqm_consumers(ob.sparkSession), F.lit("1998-12-01 12:00:00").cast("timestamp")).select("top_folder", "consumer", "n")


@query("j5_shared_queues", """WITH s AS (SELECT module, expression, paths, prescale, queue, min(seq) AS f FROM registrations WHERE is_unique GROUP BY ALL),
 q AS (SELECT CASE WHEN r.is_unique THEN 'c' || s.f ELSE r.name END AS queue_name, r.* FROM registrations r LEFT JOIN s ON r.module IS NOT DISTINCT FROM s.module AND r.expression = s.expression AND r.paths = s.paths AND r.prescale = s.prescale AND r.queue = s.queue)
 SELECT queue_name, module, expression, paths, prescale, queue, count(*) AS n_readers, min(seq) AS first, max(seq) AS last FROM q GROUP BY queue_name, module, expression, paths, prescale, queue""", re="registrations")
def queues(re):
    return sel.queue_readers(re, "seq")


ASSEMBLED = """per AS (SELECT code, run_number, event_number, originator_pid, originator_guid, secondary_id, frame_index, count(*) AS m, sum(data_size) AS b, min(arrival) AS f, max(arrival) AS l, max(num_frames) AS nf FROM fragments GROUP BY ALL),
 asm AS (SELECT run_number, event_number, CAST(sum(m) AS BIGINT) AS n_fragments, CAST(sum(b) AS BIGINT) AS event_size, min(f) AS creation_time, max(l) AS last_fragment_time, max(nf) AS expected, max(m) > 1 AS dup FROM per GROUP BY code, run_number, event_number, originator_pid, originator_guid, secondary_id),
 ev AS (SELECT *, n_fragments = expected AND NOT dup AS complete, CASE WHEN dup THEN 64 ELSE 0 END + CASE WHEN n_fragments = expected AND NOT dup THEN 0 ELSE 128 END AS fault_bits FROM asm)"""


@query("d1_assemble_events", f"WITH {ASSEMBLED} SELECT run_number, event_number, n_fragments, event_size, complete, fault_bits FROM ev", fr="fragments")
def assembled(fr):
    return assembly.assemble(fr).select("run_number", "event_number", "n_fragments", "event_size", "complete", "fault_bits")


@query("d2_fault_bits", f"WITH {ASSEMBLED} SELECT run_number, fault_bits, count(*) AS n FROM ev GROUP BY ALL", fr="fragments")
def fault_bits(fr):
    return assembly.assemble(fr).groupBy("run_number", "fault_bits").agg(F.count("*").alias("n"))


@query("d3_faulty_complete", f"WITH {ASSEMBLED} SELECT complete, CASE WHEN complete THEN fault_bits <> 0 ELSE fault_bits <> 128 END AS faulty, count(*) AS n FROM ev GROUP BY ALL", fr="fragments")
def faulty(fr):
    return assembly.assemble(fr).groupBy("complete", "faulty").agg(F.count("*").alias("n"))


@query("d6_stale_events", f"WITH {ASSEMBLED} SELECT event_number, fault_bits | 65536 AS fault_bits FROM ev WHERE NOT complete AND epoch(TIMESTAMP '1998-01-01 00:00:00') - epoch(last_fragment_time) >= 60", fr="fragments")
def stale(fr):
    return assembly.stale(assembly.assemble(fr), at("1998-01-01 00:00:00")).select("event_number", "fault_bits")


@query("d7_drain_stale", f"WITH {ASSEMBLED} SELECT run_number, count(*) AS n FROM ev WHERE NOT complete GROUP BY 1", fr="fragments")
def drained(fr):
    return assembly.stale(assembly.assemble(fr), at("1998-01-01 00:00:00"), 0).groupBy("run_number").agg(F.count("*").alias("n"))


@query("d8_chain_times", f"WITH {ASSEMBLED} SELECT event_number, CAST(epoch(creation_time) AS BIGINT) AS created, CAST(epoch(last_fragment_time) AS BIGINT) AS last_fragment FROM ev", fr="fragments")
def chain_times(fr):
    return assembly.assemble(fr).select("event_number", secs("creation_time").alias("created"), secs("last_fragment_time").alias("last_fragment"))


@query("d9_event_size", f"WITH {ASSEMBLED} SELECT run_number, CAST(sum(event_size) AS BIGINT) AS bytes, CAST(sum(n_fragments) AS BIGINT) AS fragments FROM ev GROUP BY 1", fr="fragments")
def sizes(fr):
    return assembly.assemble(fr).groupBy("run_number").agg(F.sum("event_size").alias("bytes"), F.sum("n_fragments").alias("fragments"))


@query("b13_route_faulty", f"WITH {ASSEMBLED} SELECT event_number, CASE WHEN NOT complete OR (CASE WHEN complete THEN fault_bits <> 0 ELSE fault_bits <> 128 END) THEN 'faulty' ELSE 'data' END AS branch FROM ev", fr="fragments")
def faulty_branch(fr):
    return assembly.assemble(fr).select("event_number", F.when(F.col("faulty") | ~F.col("complete"), "faulty").otherwise("data").alias("branch"))


def _adler_sql(texts: str, keys: str) -> str:
    """Adler-32 of the texts s by keys: sums of bytes, and of bytes by how many are left."""
    return f"""t AS ({texts}), c AS (SELECT {keys}, len(s) AS n, unnest(range(1, len(s) + 1)) AS i, ascii(unnest(string_split(s, ''))) AS b FROM t),
 ad AS (SELECT {keys}, CAST((sum((n - i + 1) * b) + any_value(n)) % 65521 * 65536 + (1 + sum(b)) % 65521 AS BIGINT) AS adler32 FROM c GROUP BY ALL)"""


@query("d4_adler32", f"WITH {_adler_sql("SELECT event_number, string_agg(data_size || ':' || frame_index, '' ORDER BY frame_index, data_size) AS s FROM fragments GROUP BY 1", 'event_number')} SELECT event_number, adler32 FROM ad", fr="fragments")
def adler(fr):
    """Checksums of the events' payloads, put together from those of their fragments."""
    data = F.encode(F.concat(F.col("data_size").cast("string"), F.lit(":"), F.col("frame_index").cast("string")), "UTF-8")
    return assembly.adler32_of(fr.withColumn("payload", data), ["event_number"], ["frame_index", "data_size"], "payload")


_LINES = "SELECT run_number, event_number // 1000 AS block, string_agg(event_number || ',' || frame_index || ',' || data_size || chr(10), '' ORDER BY event_number, frame_index, data_size) AS s FROM fragments GROUP BY ALL"


@query("d5_file_checksums", f"WITH {_adler_sql(_LINES, 'run_number, block')} SELECT run_number, block, adler32, TRUE AS matches FROM ad UNION ALL SELECT 0, 0, NULL, FALSE", fr="fragments")
def checksums(fr):
    """Files of a run's events, a thousand each, written from the fragments, against checksums put together from those of their lines; and one booked file that isn't there."""
    from ..sources.logs import file_checksums
    from ..sources.named_files import NamedFiles
    from ..streaming.stateful import shared_folder

    spark, key, order = fr.sparkSession, ["run_number", "block"], ["event_number", "frame_index", "data_size"]
    name = F.concat_ws(".", *key, F.lit("dat")).alias("name")
    value = F.concat("event_number", F.lit(","), "frame_index", F.lit(","), "data_size", F.lit("\n"))
    line = fr.select("run_number", F.expr("event_number div 1000").alias("block"), *order, value.alias("value")).where("value IS NOT NULL")
    spark.dataSource.register(NamedFiles)
    line.select(name, *order, "value").repartition("name").sortWithinPartitions("name", *order).select("name", "value").write.format("named_files").mode("append").save(path := shared_folder(spark, "sink"))
    want = assembly.adler32_of(line.withColumn("payload", F.encode("value", "UTF-8")), key, order, "payload")
    book = want.select(name, "adler32").unionByName(spark.createDataFrame([("0.0.dat", 7)], "name string, adler32 long"))
    part = lambda k: F.split_part("name", F.lit("."), F.lit(key.index(k) + 1)).cast("long").alias(k)
    return file_checksums(spark, f"{path}/*", book).select(part("run_number"), part("block"), "adler32", "matches")


@query("b14_unwanted_events", f"SELECT event_number FROM daq_events WHERE message_code = 'EVENT' AND len(list_filter([{_TAGGED}], lambda x: x IS NOT NULL)) = 0", ev="daq_events")
def unwanted(ev):
    return sel.unwanted(sel.stream_tags(ev.where("message_code = 'EVENT'"), STREAMS, NAMES, states(), F.col("output_module_label"), key())).select("event_number")


@query("b15_assert_run_number", "SELECT event_number, CASE WHEN message_code = 'ERROR_EVENT' THEN 100002 ELSE run_number END AS run_number, run_number <> 100002 AS run_mismatch FROM daq_events", ev="daq_events")
def asserted(ev):
    return assembly.assert_run(ev, F.lit(100002).cast("long")).select("event_number", "run_number", "run_mismatch")


@query("b16_drop_old_lumis", "SELECT run_number, count(*) AS n FROM (SELECT *, max(lumi_section) OVER (PARTITION BY run_number ORDER BY arrival, update_number, sender, lumi_section, bin, content ROWS UNBOUNDED PRECEDING) AS m FROM dqm_objects) WHERE lumi_section + 4 >= m GROUP BY 1", ob="dqm_objects")
def old_lumis(ob):
    return sel.drop_old_lumis(ob, 4, ["arrival", "update_number", "sender", "lumi_section", "bin", "content"]).groupBy("run_number").agg(F.count("*").alias("n"))


@query("b17_no_transfer", "SELECT file_key FROM files_created WHERE NOT regexp_matches(stream, '^EcalCalibration|_EcalNFS$|_NoTransfer$')", fc="files_created")
def booked(fc):
    return sel.no_transfer(fc).select("file_key")


@query("b18_lookarea_sample", "SELECT file_key FROM files_created WHERE lumisection % 6 = 2 * instance + 1 AND file_key % 3 < 1", fc="files_created")
def lookarea(fc):
    return sel.lookarea_sample(fc.withColumn("counter", F.col("file_key") % 3), 2, 3).select("file_key")


@query("b19_report_filter", "SELECT file_key FROM files_created WHERE runnumber BETWEEN 100003 AND 100012 AND filename LIKE '%.0007.%' AND NOT filename LIKE '%.05.%'", fc="files_created")
def reported(fc):
    return fc.where(sel.report_filter((100003, 100012), contains=".0007.", lacks=".05.")).select("file_key")


@query("c1_with_init", "SELECT event_number, label FROM daq_events LEFT JOIN init_messages USING (output_module_id)", ev="daq_events", init="init_messages")
def joined(ev, init):
    return sel.with_init(ev.select("event_number", "output_module_id"), F.broadcast(init)).select("event_number", "label")


@query("c2_first_init", "SELECT output_module_id, output_module_label AS label, min(event_number) AS event_number FROM daq_events WHERE output_module_label <> 'none' GROUP BY ALL", ev="daq_events")
def inits(ev):
    init = ev.select("output_module_id", F.when(F.col("output_module_label") != "none", F.col("output_module_label")).alias("label"), "event_number")
    return sel.first_init(init, ["event_number"])


@query("c3_events_x_config", "SELECT event_number, r.stream FROM daq_events JOIN (VALUES ('big', 'hltOutputA', 5000), ('all', 'hltOutputB', 0)) r(stream, module, least_size) ON output_module_label = r.module AND data_size >= r.least_size", ev="daq_events")
def config(ev):
    rules = ev.sparkSession.sql("SELECT * FROM VALUES ('big', 'hltOutputA', 5000), ('all', 'hltOutputB', 0) AS r(stream, module, least_size)")
    return ev.join(F.broadcast(rules), (F.col("output_module_label") == F.col("module")) & (F.col("data_size") >= F.col("least_size"))).select("event_number", "stream")


@query("d10_parse_event_header", "SELECT event_number, run_number, lumi_section, output_module_id, s_a, s_e, s_i, event_number % 50 <> 0 AS header_ok FROM daq_events", ev="daq_events")
def header(ev):
    """Events packed to bytes, a fiftieth of them with a wrong length, and parsed again."""
    packed = [sum((F.col(f"s_{n}").cast("int") * 4**j for j, n in enumerate(NAMES[k : k + 4])), F.lit(0)) for k in (0, 4, 8)]
    bits = F.unhex(F.concat(*(F.lpad(F.hex(p.cast("long")), 2, "0") for p in packed)))
    size = F.lit(assembly.HEADER_BYTES + 3) + F.when(F.col("event_number") % 50 == 0, 1).otherwise(0)
    fields = {"code": F.lit(2), "version": F.lit(11), "size": size, "n_paths": F.lit(len(NAMES))} | {n: F.col(n) for n in ("run_number", "event_number", "lumi_section", "output_module_id")}
    h = ev.select(assembly.parse_event_header(assembly.pack_header(fields, bits)).alias("h"))
    return h.select(*(F.col(f"h.{n}").alias(n) for n in ("event_number", "run_number", "lumi_section")), F.col("h.output_module_id").cast("int").alias("output_module_id"), *(F.col("h.states")[NAMES.index(n)].alias(f"s_{n}") for n in "aei"), "h.header_ok")


ROLL_SQL = f"""WITH RECURSIVE {ROUTED_SQL},
 o AS (SELECT stream, run_number, lumi_section, creation_time, event_number, data_size, row_number() OVER (PARTITION BY stream, run_number, lumi_section ORDER BY creation_time, event_number) AS r FROM routed),
 f AS (SELECT *, data_size AS size, 0 AS file_counter FROM o WHERE r = 1 UNION ALL
       SELECT o.*, CASE WHEN f.size + o.data_size > 200000 THEN o.data_size ELSE f.size + o.data_size END, f.file_counter + CASE WHEN f.size + o.data_size > 200000 THEN 1 ELSE 0 END FROM f JOIN o ON o.stream = f.stream AND o.run_number = f.run_number AND o.lumi_section = f.lumi_section AND o.r = f.r + 1)"""


def _assigned(ev):
    return files.assign_files(routed(ev).select(*files.GROUP, *ORDER, "data_size"), F.lit(200000), ORDER)


@query("e1_assign_files", f"{ROLL_SQL} SELECT stream, event_number, file_counter FROM f", ev="daq_events")
def assign(ev):
    return _assigned(ev).select("stream", "event_number", "file_counter")


@query("e2_file_counter", "SELECT file_key, dense_rank() OVER (PARTITION BY runnumber, lumisection, stream ORDER BY file_key) - 1 AS counter FROM files_created", fc="files_created")
def counter(fc):
    return files.file_counter(fc.withColumn("core", F.concat_ws(".", "runnumber", "lumisection", "stream")), "core", ["file_key"]).select("file_key", F.col("counter").cast("long").alias("counter"))


@query("e3_file_name", "SELECT file_key, printf('Data.%08d.%04d.%s.logger.%02d.%04d.dat', runnumber, lumisection, stream, instance, file_key % 10) AS name FROM files_created", fc="files_created")
def names(fc):
    return fc.select("file_key", files.file_name(files.core_name("Data", F.col("runnumber"), F.col("lumisection"), F.col("stream"), F.col("instance")), F.col("file_key") % 10).alias("name"))


@query("e4_logical_disk", "SELECT file_key, printf('%02d', (runnumber + instance + file_key) % 7) AS disk FROM files_created", fc="files_created")
def disks(fc):
    return fc.select("file_key", files.logical_disk(F.col("runnumber"), F.col("instance"), F.col("file_key"), 7).alias("disk"))


STATS_SQL = "s AS (SELECT stream, run_number, lumi_section, file_counter, count(*) AS n_events, CAST(sum(data_size) AS BIGINT) AS bytes, min(creation_time) AS a, max(creation_time) AS z FROM f GROUP BY ALL)"


@query("e5_file_stats", f"{ROLL_SQL}, {STATS_SQL} SELECT stream, run_number, lumi_section, file_counter, n_events, bytes, CAST(floor(epoch(a)) AS BIGINT) AS first_s, CAST(floor(epoch(z)) AS BIGINT) AS last_s FROM s", ev="daq_events")
def stats(ev):
    return files.file_stats(_assigned(ev)).select(*files.GROUP, "file_counter", "n_events", "bytes", secs("first_entry").alias("first_s"), secs("last_entry").alias("last_s"))


@query("e6_e8_close_reason", f"""{ROLL_SQL}, {STATS_SQL}, m AS (SELECT *, max(file_counter) OVER (PARTITION BY stream, run_number, lumi_section) AS last FROM s)
 SELECT stream, run_number, lumi_section, file_counter, CASE WHEN file_counter < last THEN 'file size' WHEN lumi_section % 3 = 0 THEN 'LS ended' WHEN epoch(TIMESTAMP '2024-01-20 00:00:00') - epoch(z) > 45 THEN 'timeout' ELSE 'run ended' END AS reason FROM m""", ev="daq_events")
def closing(ev):
    eols = ev.where("lumi_section % 3 = 0").select("run_number", "lumi_section").distinct()
    return files.closed(files.file_stats(_assigned(ev)), eols, at("2024-01-20 00:00:00")).select(*files.GROUP, "file_counter", files.close_reason(F.col("closing")).alias("reason"))


@query("e10_file_path", "SELECT file_key, concat('/store', CASE WHEN file_key % 4 = 0 THEN '/open/' ELSE '/closed/' END, filename) AS path FROM files_created", fc="files_created")
def paths(fc):
    return fc.select("file_key", files.file_path("/store", F.col("file_key") % 4 == 0, F.col("filename")).alias("path"))


@query("e11_size_mismatch", "SELECT file_key FROM files_injected JOIN disk_inventory USING (file_key) WHERE abs(filesize - disk_size + (file_key % 7) * 100) / greatest(filesize, disk_size - (file_key % 7) * 100) > 0.00002", fi="files_injected", di="disk_inventory")
def mismatch(fi, di):
    return fi.join(di, "file_key").where(files.size_mismatch(F.col("filesize"), F.col("disk_size") - (F.col("file_key") % 7) * 100, 0.00002)).select("file_key")


@query("e12_open_closed_counts", "SELECT stream, count(*) FILTER (file_key % 10 = 0) AS n_open, count(*) - count(*) FILTER (file_key % 10 = 0) AS n_closed FROM files_created GROUP BY 1", fc="files_created")
def open_counts(fc):
    n = F.count_if(F.col("file_key") % 10 == 0)
    return fc.groupBy("stream").agg(n.alias("n_open"), (F.count("*") - n).alias("n_closed"))


@query("e12_recent_files", "SELECT file_key, stream FROM files_created ORDER BY ctime DESC, file_key DESC LIMIT 250", fc="files_created")
def recent(fc):
    return fc.orderBy(F.desc("ctime"), F.desc("file_key")).limit(250).select("file_key", "stream")


@query("e13_lumi_file_counts", "SELECT runnumber, lumisection, stream, count(*) AS n_files FROM files_created GROUP BY ALL", fc="files_created")
def lumi_counts(fc):
    return files.lumi_file_counts(fc)


EOLS = "eols AS (SELECT DISTINCT runnumber, lumisection FROM files_created WHERE lumisection % 5 <> 0)"


@query("e14_end_of_lumi_report", f"WITH {EOLS}, c AS (SELECT runnumber, lumisection, stream, count(*) AS n FROM files_created GROUP BY ALL), sp AS (SELECT DISTINCT runnumber, lumisection FROM c), st AS (SELECT DISTINCT runnumber, stream FROM c) SELECT sp.runnumber, sp.lumisection, st.stream, coalesce(c.n, 0) AS n_files, CASE WHEN e.runnumber IS NULL THEN 0 ELSE 1 END AS eols FROM sp JOIN st USING (runnumber) LEFT JOIN c ON c.runnumber = sp.runnumber AND c.lumisection = sp.lumisection AND c.stream = st.stream LEFT JOIN eols e ON e.runnumber = sp.runnumber AND e.lumisection = sp.lumisection", fc="files_created")
def lumi_report(fc):
    return files.end_of_lumi_report(fc, fc.where("lumisection % 5 <> 0").select("runnumber", "lumisection").distinct())


@query("e15_end_of_run_report", f"WITH {EOLS} SELECT runnumber, count(DISTINCT lumisection) AS lumis_with_files, max(lumisection) AS last_lumi, count(DISTINCT lumisection) FILTER (lumisection % 5 <> 0) AS eols_count FROM files_created GROUP BY 1", fc="files_created")
def run_report(fc):
    return files.end_of_run_report(fc, fc.where("lumisection % 5 <> 0").select("runnumber", "lumisection").distinct())


@query("e16_unreported_lumis", "SELECT DISTINCT runnumber, lumisection FROM files_created WHERE lumisection % 5 = 0", fc="files_created")
def unreported(fc):
    return files.unreported_lumis(fc, fc.where("lumisection % 5 <> 0").select("runnumber", "lumisection").distinct())


_OBJ = "run_number, lumi_section, top_folder, folder, object_name, kind"
MERGED = f"""u AS (SELECT {_OBJ}, arrival, update_number, sender, sum(entries) AS n, row_number() OVER (PARTITION BY {_OBJ} ORDER BY arrival, update_number, sender) AS r FROM dqm_bins GROUP BY {_OBJ}, arrival, update_number, sender),
 b AS (SELECT {_OBJ}, bin, CAST(sum(content) AS BIGINT) AS content, CAST(sum(w) AS BIGINT) AS w, CAST(sum(wy) AS BIGINT) AS wy, CAST(sum(wyy) AS BIGINT) AS wyy, CAST(sum(entries) AS BIGINT) AS entries
       FROM dqm_bins JOIN u USING ({_OBJ}, arrival, update_number, sender) WHERE n > 0 OR r = 1 GROUP BY {_OBJ}, bin)"""


def _shown(bins, value):
    return F.array_join(F.transform(F.map_entries(bins), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), value(e["value"]))), ",")


@query("f2_merge_histograms", f"WITH {MERGED} SELECT run_number, lumi_section, top_folder, folder, object_name, string_agg(bin || ':' || content, ',' ORDER BY bin) AS bins, CAST(sum(content) AS BIGINT) AS total, CAST(sum(entries) AS BIGINT) AS entries FROM b WHERE kind = 'TH1' GROUP BY ALL", ob="dqm_bins")
def merged_histograms(ob):
    return dqm.merge_histograms(ob).select(*dqm.TOP, "folder", "object_name", _shown("bins", lambda v: v.cast("string")).alias("bins"), "total", "entries")


@query("f3_merge_profiles", f"""WITH {MERGED} SELECT run_number, lumi_section, top_folder, folder, object_name, bin, w, wy, wyy, coalesce(wy / nullif(w, 0), 0) AS mean, sqrt(greatest(0, coalesce(wyy / nullif(w, 0), 0) - coalesce(wy / nullif(w, 0), 0) * coalesce(wy / nullif(w, 0), 0))) AS spread
 FROM b WHERE kind = 'TProfile'""", ob="dqm_bins")
def merged_profiles(ob):
    m = dqm.merge_profiles(ob)
    return m.select(*dqm.TOP, "folder", "object_name", F.explode("bins").alias("bin", "v")).select(*dqm.TOP, "folder", "object_name", "bin", "v.*")


@query("f1_collate_dqm", f"WITH {MERGED} SELECT run_number, lumi_section, top_folder, CAST(sum(CASE kind WHEN 'TH1' THEN content ELSE w END) AS BIGINT) AS total, count(DISTINCT folder || object_name) AS n_objects FROM b GROUP BY ALL", ob="dqm_bins")
def collated(ob):
    return dqm.collate(ob).groupBy(*dqm.TOP).agg(F.sum("total").alias("total"), F.countDistinct(F.concat("folder", "object_name")).alias("n_objects"))


@query("f1_collate_passthrough", "SELECT run_number, top_folder, update_number, sender, CAST(sum(content) AS BIGINT) AS total FROM dqm_objects WHERE kind IN ('TH1', 'TProfile') GROUP BY ALL", ob="dqm_objects")
def passed(ob):
    return dqm.collate(ob, merge=False).groupBy("run_number", "top_folder", "update_number", "sender").agg(F.sum("total").alias("total"))


@query("f4_merge_scalars", "SELECT run_number, lumi_section, top_folder, folder, object_name, kind, content, update_number FROM (SELECT *, row_number() OVER (PARTITION BY run_number, lumi_section, top_folder, folder, object_name, kind ORDER BY arrival, update_number, sender, bin, content) AS r FROM dqm_objects WHERE kind NOT IN ('TH1', 'TProfile')) WHERE r = 1", ob="dqm_objects")
def scalars(ob):
    return dqm.merge_scalars(ob)


@query("f5_safe_element_name", "SELECT update_number, object_name AS name FROM dqm_objects WHERE kind = 'string'", ob="dqm_objects")
def element_names(ob):
    xml = F.concat(F.lit("<"), F.col("object_name"), F.lit(">i="), F.col("content").cast("string"), F.lit("</"), F.col("object_name"), F.lit(">"))
    return ob.where("kind = 'string'").select("update_number", dqm.safe_element_name(xml).alias("name"))


META = "me AS (SELECT run_number, lumi_section, top_folder, max(update_number) AS last_update, min(arrival) AS a, max(arrival) AS z, CAST(sum(greatest(1, entries)) AS BIGINT) AS merge_count, count(DISTINCT sender) AS n_updates, count(DISTINCT folder) AS n_folders FROM dqm_objects GROUP BY ALL)"


@query("f6_folder_meta", f"WITH {META} SELECT run_number, lumi_section, top_folder, last_update, CAST(epoch(a) AS BIGINT) AS first_s, merge_count, n_updates, n_folders FROM me", ob="dqm_objects")
def meta(ob):
    return dqm.folder_meta(ob).select(*dqm.TOP, "last_update", secs("first_time").alias("first_s"), "merge_count", "n_updates", "n_folders")


@query("f7_f8_dqm_ready", f"WITH {META} SELECT run_number, lumi_section, top_folder, n_updates = 12 OR epoch(TIMESTAMP '1998-11-20 00:00:00') - epoch(z) > 120 AS ready, n_updates > 12 AS too_many FROM me", ob="dqm_objects")
def dqm_ready(ob):
    return dqm.ready(dqm.folder_meta(ob), F.lit(12), at("1998-11-20 00:00:00")).select(*dqm.TOP, "ready", "too_many")


@query("f9_purge_at_run_end", f"WITH {META} SELECT run_number, count(*) FILTER (n_updates = 12) AS n_emitted, count(*) FILTER (n_updates <> 12) AS n_discarded FROM me GROUP BY 1", ob="dqm_objects")
def purge(ob):
    r = dqm.ready(dqm.folder_meta(ob), F.lit(12), at("1970-01-01 00:00:00"))
    return r.groupBy("run_number").agg(F.count_if("ready").alias("n_emitted"), F.count_if(~F.col("ready")).alias("n_discarded"))


@query("f10_expected_updates", "SELECT CAST(sum(expected) AS BIGINT) AS expected_updates FROM senders", se="senders")
def expected(se):
    from ..operators.stats import connected_senders

    return connected_senders(se).agg(F.sum("connected").alias("expected_updates"))


@query("f11_folder_table", "SELECT run_number, lumi_section, top_folder, folder, string_agg(DISTINCT object_name, ',' ORDER BY object_name) AS names FROM dqm_objects GROUP BY ALL", ob="dqm_objects")
def folders(ob):
    return dqm.folder_table(ob).select(*dqm.TOP, "folder", F.array_join("names", ",").alias("names"))


@query("f12_dqm_stats", f"WITH {META} SELECT run_number, CAST(sum(n_updates) AS BIGINT) AS updates, count(*) FILTER (n_updates = 12) AS complete_updates, CAST(sum(n_folders) AS BIGINT) AS folders FROM me GROUP BY 1", ob="dqm_objects")
def dqm_stats(ob):
    return dqm.folder_meta(ob).groupBy("run_number").agg(F.sum("n_updates").alias("updates"), F.count_if(F.col("n_updates") == 12).alias("complete_updates"), F.sum("n_folders").alias("folders"))


@query("k17_run_of_file", "SELECT file_key, runnumber AS run FROM files_created", fc="files_created")
def run_of(fc):
    return fc.select("file_key", status.run_of_file(F.col("filename")).alias("run"))


def _written(df, write, *args):
    """What is in the folder that write has filled."""
    from ..streaming.stateful import shared_folder

    path = shared_folder(df.sparkSession, "sink")
    write(df, path, *args)
    return df.sparkSession.read.parquet(path)


@query("a1_read_fragments", """SELECT 'EVENT' AS kind, run_number, event_number, frame_index, num_frames, data_size, NULL AS problem, count(*) AS n FROM fragments WHERE event_number % 50 <> 0 GROUP BY ALL
 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'checksum', count(*) FILTER (event_number % 50 = 0) FROM fragments""", fr="fragments")
def read_fragments(fr):
    """Fragments packed to frames in files, one event in fifty with a damaged payload, and read back in small ranges."""
    from ..sources import frames
    from ..streaming.stateful import shared_folder

    spark = fr.sparkSession
    spark.dataSource.register(frames.Frames)
    text = F.concat(F.encode(F.col("data_size").cast("string"), "UTF-8"), F.lit(frames.SYNC), F.lit(bytes(3)))
    good = frames.frame({"code": F.lit(2)} | {n: F.col(n) for n in ("run_number", "event_number", "originator_pid", "originator_guid", "secondary_id", "frame_index", "num_frames")}, text)
    damaged = F.concat(F.substring(good, 1, 40), F.lit(b"!"), F.substring(good, 42, 1 << 20))
    path = shared_folder(spark, "frames")
    fr.select(F.when(F.col("event_number") % 50 == 0, damaged).otherwise(good).alias("frame")).write.format("frames").mode("append").save(path)
    back = spark.read.format("frames").option("rangeBytes", 1 << 16).load(path)
    size = F.decode(F.expr("substring(payload, 1, octet_length(payload) - 7)"), "UTF-8").cast("long").alias("data_size")
    return back.select("kind", "run_number", "event_number", F.col("frame_index").cast("int").alias("frame_index"), F.col("num_frames").cast("int").alias("num_frames"), size, "problem").groupBy("kind", "run_number", "event_number", "frame_index", "num_frames", "data_size", "problem").agg(F.count("*").alias("n"))


@query("a3_write_streams", f"WITH {ROUTED_SQL} SELECT stream, CAST(run_number AS BIGINT) AS run_number, CAST(lumi_section AS BIGINT) AS lumi_section, count(*) AS n_events, CAST(sum(data_size) AS BIGINT) AS bytes FROM routed GROUP BY ALL", ev="daq_events")
def write_streams(ev):
    from ..sources.logs import write_streams as write

    back = _written(routed(ev).select(*files.GROUP, "event_number", "data_size"), write)
    return back.groupBy("stream", F.col("run_number").cast("long").alias("run_number"), F.col("lumi_section").cast("long").alias("lumi_section")).agg(F.count("*").alias("n_events"), F.sum("data_size").alias("bytes"))


@query("a4_write_error_stream", "SELECT run_number, event_number, CAST(data_size AS VARCHAR) AS payload FROM daq_events WHERE message_code = 'ERROR_EVENT'", ev="daq_events")
def write_errors(ev):
    from ..sources.logs import write_errors as write

    back = _written(ev.withColumn("payload", F.encode(F.col("data_size").cast("string"), "UTF-8")), write)
    return back.select(F.col("run_number").cast("long").alias("run_number"), "event_number", F.decode("payload", "UTF-8").alias("payload"))


@query("a5_write_faulty_stream", f"WITH {ASSEMBLED} SELECT CASE WHEN event_number % 2 = 0 THEN run_number ELSE 100 END AS run_number, count(*) AS n FROM ev WHERE CASE WHEN complete THEN fault_bits <> 0 ELSE fault_bits <> 128 END GROUP BY 1", fr="fragments")
def write_faulty(fr):
    from ..sources.logs import write_faulty as write

    e = assembly.assemble(fr).withColumn("header_ok", F.col("event_number") % 2 == 0).withColumn("lumi_section", F.lit(1))
    return _written(e, write, 100).groupBy(F.col("run_number").cast("long").alias("run_number")).agg(F.count("*").alias("n"))
