"""Queries over the books of files: lifecycle, roll-ups, views, statuses (inventory groups C4-C14, H, I, J, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import status as st
from ..functions.times import at, date_texts, duration_seconds, duration_text, secs, time_diff
from ..operators import books
from .base import QUERIES, SQL, query
from .views import view, with_views

ALL = {"fc": "files_created", "fi": "files_injected", "tn": "files_trans_new", "tc": "files_trans_copied", "tk": "files_trans_checked", "tr": "files_trans_repacked", "ti": "files_trans_inserted", "td": "files_deleted"}
T = "TIMESTAMP '2001-08-05 00:00:00'"



def now():
    return at("2001-08-05 00:00:00")


INFO = """i0 AS (SELECT c.*, i.nevents, i.filesize, i.comment_str, i.itime AS t_injected, n.itime AS t_new, p.itime AS t_copied, k.itime AS t_checked, r.itime AS t_repacked, x.itime AS t_inserted, d.dtime AS t_deleted
 FROM files_created c LEFT JOIN files_injected i USING (file_key) LEFT JOIN files_trans_new n USING (file_key) LEFT JOIN files_trans_copied p USING (file_key) LEFT JOIN files_trans_checked k USING (file_key)
 LEFT JOIN files_trans_repacked r USING (file_key) LEFT JOIN files_trans_inserted x USING (file_key) LEFT JOIN files_deleted d USING (file_key)),
 info AS (SELECT *, CASE WHEN t_injected IS NULL THEN -1 WHEN t_new IS NULL THEN 0 WHEN t_copied IS NULL THEN 1 WHEN t_checked IS NULL THEN 10 WHEN t_deleted IS NOT NULL THEN 40 WHEN t_repacked IS NULL THEN 20 WHEN t_inserted IS NULL THEN 30 ELSE 35 END AS status FROM i0)"""


def info_of(fc, fi, tn, tc, tk, tr, ti, td):
    return books.files_info(fc, {"injected": fi, "new": tn, "copied": tc, "checked": tk, "repacked": tr, "inserted": ti, "deleted": td})


def _sum_sql(keys):
    e = lambda c: f"CAST(floor(epoch({c})) AS BIGINT)"
    own = "producer = 'Logger'"
    return f"""sm AS (SELECT {keys}, count(*) FILTER ({own}) AS s_created, CAST(coalesce(sum(lumisection) FILTER ({own}), 0) AS BIGINT) AS s_lumisection, max(instance) FILTER ({own}) AS m_instance, {e(f'min(ctime) FILTER ({own})')} AS start_write_s,
 count(t_injected) AS s_injected, CAST(coalesce(sum(nevents), 0) AS BIGINT) AS s_nevents, CAST(coalesce(sum(filesize), 0) AS BIGINT) AS s_filesize, count(DISTINCT instance) FILTER (t_injected IS NOT NULL) AS n_instance, {e('max(t_injected)')} AS stop_write_s, min(comment_str) AS hltkey,
 count(t_new) AS s_new, {e('min(t_new)')} AS start_trans_s, count(t_copied) AS s_copied, {e('max(t_copied)')} AS stop_trans_s, CAST(coalesce(sum(filesize) FILTER (t_copied IS NOT NULL), 0) AS BIGINT) AS s_filesize2t0,
 count(t_checked) AS s_checked, count(*) FILTER (t_checked IS NOT NULL AND (stream = 'Error' OR ends_with(stream, '_NoRepack'))) AS s_notrepacked, {e('min(t_checked)')} AS start_repack_s, count(t_repacked) AS s_repacked, {e('max(t_repacked)')} AS stop_repack_s,
 count(t_deleted) AS s_deleted, min(hostname) AS hostname, min(setuplabel) AS setuplabel FROM info GROUP BY {keys})"""


_TIMES = ["start_write", "stop_write", "start_trans", "stop_trans", "start_repack", "stop_repack"]


def summed(keys, *tables):
    """The roll-up with times as seconds."""
    s = books.summary(info_of(*tables), keys)
    return s.select(*(c for c in s.columns if not c.endswith("_time")), *(secs(f"{t}_time").alias(f"{t}_s") for t in _TIMES))


def _pick(name, keys, cols, doc=""):
    """A query of some columns of the roll-up by keys."""
    query(name, f"WITH {INFO}, {_sum_sql(', '.join(keys))} SELECT {', '.join([*keys, *cols])} FROM sm", **ALL)(lambda *t: summed(keys, *t).select(*keys, *cols))


RS, RI = ["runnumber", "stream"], ["runnumber", "instance"]
for _n, _k, _c in (
    ("h1_summary_created", RS, ["s_created", "s_lumisection", "m_instance", "start_write_s"]), ("h2_instances_created", RI, ["s_created", "start_write_s", "hostname", "setuplabel"]),
    ("h3_summary_injected", RS, ["s_injected", "s_nevents", "s_filesize", "n_instance", "stop_write_s", "hltkey"]), ("h4_instances_injected", RI, ["s_injected", "stop_write_s"]),
    ("h5_trans_new", RS, ["s_new", "start_trans_s"]), ("h6_trans_copied", RS, ["s_copied", "stop_trans_s", "s_filesize2t0"]), ("h7_trans_checked", RS, ["s_checked", "s_notrepacked", "start_repack_s"]),
    ("h8_trans_repacked", RS, ["s_repacked", "stop_repack_s"]), ("h9_files_deleted", RI, ["s_deleted"]),
):
    _pick(_n, _k, _c)


def _booked(spark, sf_dir, files: int = 6):
    """The books as a stream of events in ``files`` micro-batches, over which the stages of a file are spread at random; a fifth of the events is sent twice."""
    from ..streaming import books_stream as bs, stateful as ss

    names = {"created": "files_created", "injected": "files_injected", **{s: f"files_trans_{s}" for s in books.STAGES[1:]}, "deleted": "files_deleted"}
    events = bs.events_of({stage: view(spark, sf_dir, v) for stage, v in names.items()})
    n = F.pmod(F.xxhash64("stage", "file_key"), F.lit(files))
    again = F.when(F.pmod(F.xxhash64("file_key", "stage"), F.lit(5)) == 0, F.pmod(F.xxhash64("file_key"), F.lit(files)))
    sent = events.withColumn("__n", F.explode(F.array_compact(F.array(n, again))))
    parts = max(files, int(spark.conf.get("spark.sql.shuffle.partitions")))  # as many tasks, whatever the number of micro-batches
    sent.repartition(parts, "__n", F.xxhash64("stage", "file_key")).drop("__n").write.parquet(f"{(folder := ss.shared_folder(spark, 'books'))}/in.parquet")
    store = bs.Books(spark, f"{folder}/books")
    return store, bs.run(ss.read_table(spark, folder, "in", -(-parts // files)), store, ss.shared_folder(spark, "state"))


def _streamed(spark, sf_dir, keys):
    store, last = _booked(spark, sf_dir)
    out = store.summary(keys, last)
    return out.select(*(c for c in out.columns if not c.endswith("_time")), *(secs(f"{t}_time").alias(f"{t}_s") for t in _TIMES))


for _n, _k, _c in (("h1_h8_stream_summary", RS, ["s_created", "s_lumisection", "m_instance", "start_write_s", "s_injected", "s_nevents", "s_filesize", "n_instance", "stop_write_s", "hltkey", "s_new", "start_trans_s", "s_copied", "stop_trans_s", "s_filesize2t0", "s_checked", "s_notrepacked", "start_repack_s", "s_repacked", "stop_repack_s"]), ("h2_h9_stream_instances", RI, ["s_created", "start_write_s", "hostname", "setuplabel", "s_injected", "stop_write_s", "s_deleted"])):
    QUERIES[_n] = lambda spark, sf_dir, k=_k, c=_c: _streamed(spark, sf_dir, k).select(*k, *c)
    SQL[_n] = with_views(f"WITH {INFO}, {_sum_sql(', '.join(_k))} SELECT {', '.join([*_k, *_c])} FROM sm")


def _entered(spark, sf_dir):
    """Created and injected files entered by a stream in which a fifth is sent twice: each once."""
    store, last = _booked(spark, sf_dir)
    return store.files(last).where("stage IN ('created', 'injected')").select("file_key", "stage", "filename", "nevents", "filesize")


QUERIES["c11_a12_stream_entries"] = _entered
SQL["c11_a12_stream_entries"] = with_views("SELECT file_key, 'created' AS stage, filename, NULL::BIGINT AS nevents, NULL::BIGINT AS filesize FROM files_created UNION ALL SELECT file_key, 'injected', NULL, nevents, filesize FROM files_injected")


@query("c4_files_info", f"WITH {INFO} SELECT file_key, filename, stream, status, nevents FROM info", **ALL)
def info(*t):
    return info_of(*t).select("file_key", "filename", "stream", "status", "nevents")


@query("c4_status_counts", f"WITH {INFO} SELECT CASE status WHEN -1 THEN 'CREATED' WHEN 0 THEN 'INJECTED' WHEN 1 THEN 'NEW' WHEN 10 THEN 'COPIED' WHEN 20 THEN 'CHECKED' WHEN 30 THEN 'REPACKED' WHEN 35 THEN 'INSERTED' ELSE 'DELETED' END AS text, count(*) AS n FROM info GROUP BY 1", **ALL)
def counts(*t):
    return info_of(*t).groupBy(books.status_text(F.col("status")).alias("text")).agg(F.count("*").alias("n"))


_DEL = f"WITH {INFO} SELECT file_key FROM info WHERE t_injected IS NOT NULL AND t_checked IS NOT NULL AND t_deleted IS NULL AND epoch({T}) - epoch(ctime) > 86400 * 30 AND epoch({T}) - epoch(coalesce(t_repacked, t_checked)) > 86400 * 40"


def _deletable(t, cap=None):
    fc, fi, tn, tc, tk, tr, ti, td = t
    return books.deletable_files(fc, {"injected": fi, "checked": tk, "repacked": tr, "deleted": td}, now(), 86400 * 30, 86400 * 40, cap).select("file_key")


query("c5_deletable_files", _DEL, **ALL)(lambda *t: _deletable(t))
query("j2_deletable_oldest", f"{_DEL} ORDER BY ctime, file_key LIMIT 100", **ALL)(lambda *t: _deletable(t, 100))


@query("c6_orphans_report", "SELECT d.file_key, c.hostname, i.nevents FROM disk_inventory d LEFT JOIN files_created c USING (file_key) LEFT JOIN files_injected i USING (file_key)", di="disk_inventory", fc="files_created", fi="files_injected")
def orphans(di, fc, fi):
    return di.select("file_key").join(fc.select("file_key", "hostname"), "file_key", "left").join(fi.select("file_key", "nevents"), "file_key", "left")


@query("c7_reconcile_inventory", """WITH d AS (SELECT runnumber, instance, count(*) AS n_disk FROM disk_inventory WHERE runnumber > 100003 GROUP BY ALL), b AS (SELECT runnumber, instance, count(*) AS n_injected FROM files_created JOIN files_injected USING (file_key) WHERE runnumber > 100003 GROUP BY ALL),
 x AS (SELECT runnumber, instance, count(*) AS n_deleted FROM files_created JOIN files_deleted USING (file_key) WHERE runnumber > 100003 GROUP BY ALL), j AS (SELECT runnumber, instance, coalesce(n_disk, 0) AS n_disk, coalesce(n_injected, 0) AS n_injected, coalesce(n_deleted, 0) AS n_deleted FROM d FULL JOIN b USING (runnumber, instance) FULL JOIN x USING (runnumber, instance))
 SELECT *, CASE WHEN n_disk = 0 THEN 0 ELSE n_disk - n_injected + n_deleted END AS n_unaccount FROM j""", di="disk_inventory", fc="files_created", fi="files_injected", td="files_deleted")
def reconcile(di, fc, fi, td):
    keys = fc.select("file_key", "runnumber", "instance")
    return books.reconcile_inventory(di, fi.select("file_key").join(keys, "file_key"), td.select("file_key").join(keys, "file_key"), 100003)


@query("c9_with_run_conditions", "WITH r AS (SELECT runnumber, concat('key', CAST(runnumber % 3 AS VARCHAR)) AS hlt, CAST(count(DISTINCT instance) AS VARCHAR) AS n FROM files_created GROUP BY 1) SELECT file_key, hlt AS hltkey, n AS n_instances FROM files_created JOIN r USING (runnumber)", fc="files_created")
def conditions(fc):
    r = fc.groupBy("runnumber").agg(F.concat(F.lit("key"), F.first(F.col("runnumber") % 3).cast("string")).alias("hltkey"), F.countDistinct("instance").cast("string").alias("n_instances"))
    c = r.select("runnumber", F.expr("stack(2, 'hltkey', hltkey, 'n_instances', n_instances) AS (name, value)"))
    return books.with_run_conditions(fc, c, ["hltkey", "n_instances"]).select("file_key", "hltkey", "n_instances")


@query("c10_previous_same_label_run", "SELECT runnumber, setuplabel, n, lag(n) OVER (PARTITION BY setuplabel ORDER BY runnumber) AS previous_n FROM (SELECT runnumber, setuplabel, count(DISTINCT instance) AS n FROM files_created GROUP BY ALL)", fc="files_created")
def previous(fc):
    return books.previous_same_label(fc.groupBy("runnumber", "setuplabel").agg(F.countDistinct("instance").alias("n")))


@query("c11_dedupe_files", "SELECT file_key FROM (SELECT *, row_number() OVER (PARTITION BY runnumber, lumisection, instance ORDER BY ctime, file_key) AS r FROM files_created) WHERE r = 1", fc="files_created")
def dedupe(fc):
    keyed = fc.withColumn("name", F.concat_ws(".", "runnumber", "lumisection", "instance"))
    return books.dedupe_files(keyed, "name", ["ctime", "file_key"])[0].select("file_key")


@query("c12_orphan_stage_rows", "SELECT file_key FROM files_deleted WHERE file_key NOT IN (SELECT file_key FROM disk_inventory)", td="files_deleted", di="disk_inventory")
def orphan_rows(td, di):
    return books.orphan_rows(td, di).select("file_key")


def _rates(name, first, last, state):
    query(name, f"WITH {INFO}, g AS (SELECT runnumber, sum(filesize) AS b, epoch(max({last})) - epoch(min({first})) AS d FROM info WHERE status > {state} GROUP BY 1) SELECT runnumber, CASE WHEN d = 0 THEN -999 ELSE round(b / 1048576 / d, 2) END AS mb_s FROM g", **ALL)(lambda *t: books.rate(info_of(*t), first, last, state))


_rates("h15_rate_average", "ctime", "t_copied", 10)
_rates("h16_rate_to_disk", "ctime", "t_injected", 0)
_rates("h17_rate_to_t0", "t_new", "t_copied", 10)


@query("c14_rate_scalars", f"WITH {INFO} SELECT CAST(sum(filesize) AS BIGINT) AS bytes, CAST(epoch(max(t_copied)) - epoch(min(ctime)) AS BIGINT) AS seconds FROM info WHERE status > 10", **ALL)
def scalars(*t):
    return info_of(*t).where("status > 10").agg(F.sum("filesize").alias("bytes"), (secs(F.max("t_copied")) - secs(F.min("ctime"))).alias("seconds"))


@query("h10_rebuild_summary", f"WITH {INFO} SELECT runnumber, stream, count(*) FILTER (producer = 'Logger') AS s_created, count(t_checked) AS s_checked FROM info WHERE runnumber NOT IN (SELECT runnumber FROM files_created WHERE setuplabel = 'TransferTest') GROUP BY ALL", **ALL)
def rebuild(*t):
    return books.rebuild_summary(info_of(*t), t[0].where("setuplabel = 'TransferTest'").select("runnumber")).select("runnumber", "stream", "s_created", "s_checked")


_LINES = "SELECT runnumber AS run, instance, lumisection AS lumi, CASE WHEN lumisection = 1 THEN 'BoR' WHEN lumisection = 24 THEN 'EoR' ELSE 'EoLS' END AS kind, ctime AS ts FROM files_created"


def _lines(fc):
    k = F.when(F.col("lumisection") == 1, "BoR").when(F.col("lumisection") == 24, "EoR").otherwise("EoLS")
    return fc.select(F.col("runnumber").alias("run"), "instance", F.col("lumisection").alias("lumi"), k.alias("kind"), F.col("ctime").alias("ts"))


@query("h11_begin_end_of_run", f"WITH l AS ({_LINES}) SELECT run, instance, max(CASE kind WHEN 'BoR' THEN 1 ELSE 0 END) AS begun, max(CASE kind WHEN 'EoR' THEN 1 ELSE 0 END) AS ended, CAST(epoch(min(ts) FILTER (kind = 'BoR')) AS BIGINT) AS start_s, CAST(epoch(max(ts) FILTER (kind = 'EoR')) AS BIGINT) AS end_s, count(DISTINCT lumi) FILTER (kind = 'EoLS') AS n_lumis, CASE WHEN max(CASE kind WHEN 'EoR' THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS status FROM l GROUP BY ALL", fc="files_created")
def run_ends(fc):
    b = books.begin_end_of_run(_lines(fc))
    return b.select("run", "instance", "begun", "ended", secs("start_time").alias("start_s"), secs("end_time").alias("end_s"), "n_lumis", "status")


_SECTIONS = "SELECT DISTINCT runnumber AS run, lumisection AS lumi FROM files_created"


@query("h12_lumi_consistency", f"WITH l AS ({_SECTIONS}), t AS (SELECT run, max(lumi) AS m FROM l GROUP BY 1), sp AS (SELECT run, unnest(range(1, m + 1)) AS lumi FROM t), b AS (SELECT * FROM sp ANTI JOIN l USING (run, lumi)), g AS (SELECT run, min(lumi) AS f, count(*) AS n FROM b GROUP BY 1) SELECT t.run, CAST(m AS BIGINT) AS max_lumi, CAST(coalesce(f - 1, m) AS BIGINT) AS last_good, coalesce(n, 0) AS n_bad FROM t LEFT JOIN g USING (run)", fc="files_created")
def consistency(fc):
    return books.lumi_consistency(fc.select(F.col("runnumber").alias("run"), F.col("lumisection").alias("lumi")))


@query("h14_destination", "SELECT file_key, CASE WHEN setuplabel LIKE '%TransferTest%' THEN 'TransferTest' WHEN regexp_matches(stream, '^Error$|_NoRepack$') THEN 'GlobalNoRepacking' ELSE 'Global' END AS destination FROM files_created", fc="files_created")
def destination(fc):
    return fc.select("file_key", books.destination(F.col("setuplabel"), F.col("stream")).alias("destination"))


@query("h18_view_open", f"WITH {INFO}, o AS (SELECT * FROM info WHERE status = -1 AND epoch({T}) - epoch(ctime) < 86400 * 700) SELECT 'files' AS label, CAST(count(*) AS VARCHAR) AS value FROM o UNION SELECT 'oldest', CAST(CAST(epoch(min(ctime)) AS BIGINT) AS VARCHAR) FROM o UNION SELECT 'run', CAST(min_by(runnumber, struct_pack(a := ctime, b := file_key)) AS VARCHAR) FROM o", **ALL)
def view_open(*t):
    o = info_of(*t).where((F.col("status") == -1) & (secs(now()) - secs("ctime") < 86400 * 700))
    return books.labelled({"files": F.count("*"), "oldest": secs(F.min("ctime")), "run": F.min_by("runnumber", F.struct("ctime", "file_key"))}, o)


@query("h19_view_closed", f"WITH {INFO} SELECT count(*) FILTER (status > 0) AS n0, count(*) FILTER (status > 1) AS n1, count(*) FILTER (status > 10) AS n10, round(sum(filesize) FILTER (status > 0) / 1073741824, 6) AS gb0, round(sum(filesize) FILTER (status > 1) / 1073741824, 6) AS gb1, round(sum(filesize) FILTER (status > 10) / 1073741824, 6) AS gb10 FROM info", **ALL)
def view_closed(*t):
    i = info_of(*t)
    s = F.col("status")
    return i.agg(*(F.count_if(s > k).alias(f"n{k}") for k in (0, 1, 10)), *(F.round(F.sum(F.when(s > k, F.col("filesize"))) / 1073741824, 6).alias(f"gb{k}") for k in (0, 1, 10)))


@query("h20_view_last", f"WITH {INFO} SELECT 'start' AS label, CAST(CAST(epoch(max(ctime)) AS BIGINT) AS VARCHAR) AS value FROM info UNION SELECT 'close', CAST(CAST(epoch(max(t_injected)) AS BIGINT) AS VARCHAR) FROM info UNION SELECT 'transfer', CAST(CAST(epoch(max(t_copied)) AS BIGINT) AS VARCHAR) FROM info", **ALL)
def view_last(*t):
    return books.labelled({"start": secs(F.max("ctime")), "close": secs(F.max("t_injected")), "transfer": secs(F.max("t_copied"))}, info_of(*t))


@query("h21_view_last_run", f"WITH {INFO} SELECT runnumber, count(*) AS files, count(t_injected) AS closed, count(t_copied) AS copied, count(DISTINCT hostname) AS hosts, count(DISTINCT stream) AS streams, count(DISTINCT lumisection) AS lumis FROM info WHERE runnumber = (SELECT max(runnumber) FROM info) GROUP BY 1", **ALL)
def last_run(*t):
    i = books.last_n_runs(info_of(*t), 1)
    return i.groupBy("runnumber").agg(F.count("*").alias("files"), F.count("t_injected").alias("closed"), F.count("t_copied").alias("copied"), F.countDistinct("hostname").alias("hosts"), F.countDistinct("stream").alias("streams"), F.countDistinct("lumisection").alias("lumis"))


@query("h22_view_last_runs", f"WITH {INFO}, r AS (SELECT DISTINCT runnumber FROM info ORDER BY 1 DESC LIMIT 10), g AS (SELECT runnumber, CAST(sum(filesize) AS BIGINT) AS bytes, CAST(sum(nevents) AS BIGINT) AS events, count(*) AS created, count(t_injected) AS injected, count(t_copied) AS copied, epoch(max(t_injected)) - epoch(min(ctime)) AS d FROM info WHERE runnumber IN (SELECT runnumber FROM r) GROUP BY 1) SELECT runnumber, bytes, events, created, injected, copied, round(bytes / 1048576 / d, 4) AS mb_s FROM g", **ALL)
def last_runs(*t):
    g = books.last_n_runs(info_of(*t), 10).groupBy("runnumber").agg(F.sum("filesize").alias("bytes"), F.sum("nevents").alias("events"), F.count("*").alias("created"), F.count("t_injected").alias("injected"), F.count("t_copied").alias("copied"), (secs(F.max("t_injected")) - secs(F.min("ctime"))).alias("d"))
    return g.select("runnumber", "bytes", "events", "created", "injected", "copied", F.round(F.col("bytes") / 1048576 / F.col("d"), 4).alias("mb_s"))


_AGE = f"abs(epoch({T}) - stop_write_s)"
_RUN_SQL = f"""WITH {INFO}, {_sum_sql('runnumber')}, q AS (SELECT *, {_AGE} AS age FROM sm)
 SELECT runnumber, setuplabel, substr(hltkey, 8) AS hltkey, coalesce(n_instance, m_instance + 1) AS instances, s_nevents, round(s_filesize / 1073741824, 6) AS gb, round(s_filesize / 1048576 / greatest(stop_write_s - start_write_s, 1), 6) AS mb_s,
 round(s_filesize2t0 / 1048576 / greatest(stop_trans_s - start_trans_s, 1), 6) AS t0_mb_s, s_created - s_injected AS open, s_injected, s_new, s_copied, s_checked, s_repacked, s_deleted,
 CASE WHEN s_created - s_injected > 0 AND age > 360 THEN 2 WHEN s_created - s_injected > 0 THEN 1 ELSE 0 END AS open_status,
 CASE WHEN s_new = s_injected THEN 0 WHEN age < 1800 THEN 1 WHEN s_injected = s_deleted THEN CASE WHEN s_injected > s_new THEN 2 ELSE 1 END WHEN s_injected > s_new THEN 3 ELSE 1 END AS injected_status,
 CASE WHEN s_new = s_copied THEN 0 WHEN age < 1800 THEN 1 WHEN s_new > s_copied THEN 3 ELSE 1 END AS transferred_status, CASE WHEN s_checked = s_copied THEN 0 WHEN age < 900 THEN 1 ELSE 3 END AS checked_status,
 CASE WHEN s_repacked = s_checked THEN 0 WHEN s_repacked = s_checked - s_notrepacked THEN 4 WHEN abs(epoch({T}) - stop_trans_s) > 378000 AND s_checked > s_deleted THEN 3 WHEN abs(epoch({T}) - stop_trans_s) > 14400 AND s_checked > s_deleted THEN 2 ELSE 1 END AS repacked_status,
 CASE WHEN setuplabel LIKE '%TransferTest%' THEN 2 ELSE 0 END AS setup_status FROM q"""


def _run_view(*t):
    s = books.summary(info_of(*t), ["runnumber"])
    age, n = st.age(now(), F.col("stop_write_time")), F.coalesce("n_instance", F.col("m_instance") + 1)
    span = lambda a, b: F.greatest(secs(b) - secs(a), F.lit(1))
    return s.select(
        "runnumber", "setuplabel", F.substring("hltkey", 8, 100).alias("hltkey"), n.alias("instances"), "s_nevents", F.round(F.col("s_filesize") / 1073741824, 6).alias("gb"), F.round(F.col("s_filesize") / 1048576 / span("start_write_time", "stop_write_time"), 6).alias("mb_s"),
        F.round(F.col("s_filesize2t0") / 1048576 / span("start_trans_time", "stop_trans_time"), 6).alias("t0_mb_s"), (F.col("s_created") - F.col("s_injected")).alias("open"), "s_injected", "s_new", "s_copied", "s_checked", "s_repacked", "s_deleted",
        st.open_status(F.col("s_created"), F.col("s_injected"), age).alias("open_status"), st.injected_check(F.col("s_new"), F.col("s_injected"), F.col("s_deleted"), n, age).alias("injected_status"),
        st.transferred_check(F.col("s_new"), F.col("s_copied"), n, age).alias("transferred_status"), st.checked_check(F.col("s_checked"), F.col("s_copied"), n, age).alias("checked_status"),
        st.repacked_check(F.col("s_repacked"), F.col("s_notrepacked"), F.col("s_checked"), F.col("s_deleted"), st.age(now(), F.col("stop_trans_time"))).alias("repacked_status"), st.setup_status(F.col("setuplabel")).alias("setup_status"),
    )


query("h23_run_summary_full", _RUN_SQL, **ALL)(_run_view)
query("h24_run_summary", f"SELECT runnumber, gb, mb_s, open, s_injected, s_copied, open_status, transferred_status FROM ({_RUN_SQL})", **ALL)(lambda *t: _run_view(*t).select("runnumber", "gb", "mb_s", "open", "s_injected", "s_copied", "open_status", "transferred_status"))


@query("h25_run_summary_undeleted", f"WITH {INFO}, {_sum_sql('runnumber')} SELECT runnumber, s_created - s_deleted AS left_files, CAST((epoch({T}) - stop_write_s) // 86400 AS BIGINT) AS age_days FROM sm WHERE s_created > s_deleted AND epoch({T}) - stop_write_s BETWEEN 5 * 3600 + 1 AND 65 * 86400 - 1", **ALL)
def undeleted(*t):
    s = summed(["runnumber"], *t).withColumn("a", secs(now()) - F.col("stop_write_s"))
    return s.where((F.col("s_created") > F.col("s_deleted")) & (F.col("a") > 5 * 3600) & (F.col("a") < 65 * 86400)).select("runnumber", (F.col("s_created") - F.col("s_deleted")).alias("left_files"), F.floor(F.col("a") / 86400).alias("age_days"))


def _streams(name, n, label):
    sql = f"""WITH {INFO}, {_sum_sql('runnumber, stream')}, r AS (SELECT DISTINCT runnumber FROM sm ORDER BY 1 DESC LIMIT {n}), w AS (SELECT *, max(s_nevents) OVER (PARTITION BY runnumber) AS most FROM sm WHERE runnumber IN (SELECT runnumber FROM r) {label})
 SELECT runnumber, stream, s_created, s_injected, round(s_nevents / nullif(s_injected, 0), 6) AS events_per_file, round(s_filesize / 1024 / nullif(s_nevents, 0), 6) AS kb_per_event, CASE WHEN stream LIKE '%Error%' THEN 1 WHEN stream LIKE '%\\_NoRepack%' ESCAPE '\\' THEN 2 ELSE 0 END AS stream_status,
 CASE WHEN stream LIKE '%Error%' AND most > 1000 AND most / (s_nevents + 1) < 100 THEN 2 WHEN stream LIKE '%Error%' AND most > 1000 AND most / (s_nevents + 1) < 1000 THEN 1 ELSE 0 END AS nevents_status,
 CASE WHEN s_filesize / 1048576 / greatest(stop_write_s - start_write_s, 1) < 2000 THEN 0 ELSE 1 END AS write_status FROM w"""

    def f(*t):
        s = books.last_n_runs(books.summary(info_of(*t), RS), n)
        s = s.where(~F.col("hltkey").contains("key0")) if label else s
        s = s.withColumn("most", F.max("s_nevents").over(Window.partitionBy("runnumber")))
        mb = F.col("s_filesize") / 1048576 / F.greatest(secs("stop_write_time") - secs("start_write_time"), F.lit(1))
        return s.select("runnumber", "stream", "s_created", "s_injected", F.round(F.try_divide("s_nevents", "s_injected"), 6).alias("events_per_file"), F.round(F.try_divide(F.col("s_filesize") / 1024, F.col("s_nevents")), 6).alias("kb_per_event"), st.stream_status(F.col("stream")).alias("stream_status"), st.nevents_check(F.col("stream"), F.col("s_nevents"), F.col("most")).alias("nevents_status"), st.write_status(mb).alias("write_status"))

    query(name, sql, **ALL)(f)


_streams("h26_stream_summary", 2, "AND hltkey NOT LIKE '%key0%'")
_streams("h27_stream_summary_full", 30, "")

_INST_SQL = f"""WITH {INFO}, {_sum_sql('runnumber, instance')}, r AS (SELECT DISTINCT runnumber FROM sm ORDER BY 1 DESC LIMIT 25), k AS (SELECT *, epoch({T}) - stop_write_s AS age, dense_rank() OVER (PARTITION BY runnumber ORDER BY instance) AS rank FROM sm WHERE runnumber IN (SELECT runnumber FROM r))
 SELECT runnumber, instance, rank, hostname, s_created, s_injected, CASE WHEN s_created = s_injected THEN 0 WHEN age < 301 THEN 1 ELSE 2 END AS closed_status, CASE WHEN s_new = s_copied THEN 0 WHEN age < 301 THEN 1 ELSE 2 END AS copied_status,
 CASE WHEN s_repacked = s_checked THEN 0 WHEN age > 300 THEN 2 ELSE 1 END AS repacked_status, CASE WHEN s_deleted = s_checked OR s_deleted = s_repacked OR s_deleted = s_created THEN 0 WHEN age < 29555 THEN 1 WHEN age > 60550 THEN 3 WHEN age > 29550 THEN 2 ELSE 1 END AS deleted_status FROM k"""


def _inst_view(*t):
    s = books.rank_instances(books.last_n_runs(books.summary(info_of(*t), RI), 25)).withColumn("age", secs(now()) - secs("stop_write_time"))
    c = F.col
    return s.select("runnumber", "instance", "rank", "hostname", "s_created", "s_injected", st.pair_status(c("s_created"), c("s_injected"), c("age")).alias("closed_status"), st.pair_status(c("s_new"), c("s_copied"), c("age")).alias("copied_status"), st.repacked_pair(c("s_repacked"), c("s_checked"), c("age")).alias("repacked_status"), st.deleted_pair(c("s_deleted"), [c("s_checked"), c("s_repacked"), c("s_created")], c("age")).alias("deleted_status"))


query("h28_instance_view", _INST_SQL, **ALL)(_inst_view)
query("h29_instance_view_part2", f"{_INST_SQL} WHERE 8 * (rank - 1) + instance > 8", **ALL)(lambda *t: _inst_view(*t).where("8 * (rank - 1) + instance > 8"))
query("i2_rank_instances", "SELECT DISTINCT runnumber, instance, dense_rank() OVER (PARTITION BY runnumber ORDER BY instance) AS rank FROM files_created", fc="files_created")(lambda fc: books.rank_instances(fc.select("runnumber", "instance").distinct()))
query("i1_last_n_runs", "SELECT file_key FROM (SELECT file_key, dense_rank() OVER (ORDER BY runnumber DESC NULLS LAST) AS r FROM files_created) WHERE r <= 10", fc="files_created")(lambda fc: books.last_n_runs(fc.select("file_key", "runnumber"), 10).select("file_key"))
query("j4_union_rows", "SELECT stream AS name FROM files_created UNION SELECT hostname FROM files_created", fc="files_created")(lambda fc: fc.select(F.col("stream").alias("name")).union(fc.select("hostname")).distinct())
query("j1_run_stream_order", "SELECT runnumber, stream, count(*) AS n FROM files_created GROUP BY ALL ORDER BY runnumber DESC, stream", fc="files_created")(lambda fc: fc.groupBy("runnumber", "stream").agg(F.count("*").alias("n")).orderBy(F.desc("runnumber"), "stream"))


@query("h30_instance_summary", f"WITH {INFO}, {_sum_sql('runnumber, instance')}, g AS (SELECT runnumber, count(*) AS n, max(instance) AS m, min(s_created) AS min_created, max(s_created) AS max_created, min(s_injected) AS min_injected, max(s_injected) AS max_injected, min(s_copied) AS min_copied, max(s_copied) AS max_copied, min(s_deleted) AS min_deleted, max(s_deleted) AS max_deleted FROM sm GROUP BY 1) SELECT * FROM g", **ALL)
def inst_summary(*t):
    s = books.summary(info_of(*t), RI)
    return s.groupBy("runnumber").agg(F.count("*").alias("n"), F.max("instance").alias("m"), *(f(f"s_{c}").alias(f"{g}_{c}") for c in ("created", "injected", "copied", "deleted") for g, f in (("min", F.min), ("max", F.max))))


def _flag(name, label, cond_sql, cond, value):
    sql = f"WITH {INFO}, {_sum_sql('runnumber, instance')}, w AS (SELECT *, epoch({T}) - stop_write_s AS age, max(s_injected) OVER p AS max_closed, max(stop_write_s) OVER p AS last_s, max(s_new) OVER p AS max_new, max(s_copied) OVER p AS max_copied, max(s_checked) OVER p AS max_checked FROM sm WINDOW p AS (PARTITION BY runnumber)), f AS (SELECT runnumber, string_agg(instance || '(' || {value} || ')', ' ' ORDER BY instance) FILTER ({cond_sql}) AS x FROM w GROUP BY 1) SELECT runnumber, CASE WHEN x IS NULL THEN '' ELSE ' {label}: ' || x END AS flags FROM f"

    def f(*t):
        p = Window.partitionBy("runnumber")
        s = books.summary(info_of(*t), RI)
        s = s.select("*", (secs(now()) - secs("stop_write_time")).alias("age"), F.max("s_injected").over(p).alias("max_closed"), (F.max(secs("stop_write_time")).over(p) - secs("stop_write_time")).alias("lag"), F.max("s_new").over(p).alias("max_new"), F.max("s_copied").over(p).alias("max_copied"), F.max("s_checked").over(p).alias("max_checked"))
        return books.flags(s, label, cond(), F.col(value))

    query(name, sql, **ALL)(f)


_c = F.col
_flag("h31_flag_notfiles", "!File", "age > 1800 AND s_created - s_injected > 2", lambda: (_c("age") > 1800) & (_c("s_created") - _c("s_injected") > 2), "s_created")
_flag("h32_flag_closed", "!Close", "max_closed >= 25 AND (last_s - stop_write_s > 660 OR (max_closed - s_injected > 0.33 * max_closed AND max_closed > 50))", lambda: (_c("max_closed") >= 25) & ((_c("lag") > 660) | ((_c("max_closed") - _c("s_injected") > 0.33 * _c("max_closed")) & (_c("max_closed") > 50))), "s_injected")
_flag("h33_flag_injected", "!Inj", "(0.7 * s_injected * max_new / max_closed > s_new AND s_injected > 20) OR (max_new > 50 AND s_new = 0)", lambda: ((0.7 * _c("s_injected") * _c("max_new") / _c("max_closed") > _c("s_new")) & (_c("s_injected") > 20)) | ((_c("max_new") > 50) & (_c("s_new") == 0)), "s_new")
_flag("h34_flag_transferred", "!Tran", "(0.7 * s_new * max_copied / max_new > s_copied AND max_copied > 5) OR (max_copied > 50 AND s_copied = 0)", lambda: ((0.7 * _c("s_new") * _c("max_copied") / _c("max_new") > _c("s_copied")) & (_c("max_copied") > 5)) | ((_c("max_copied") > 50) & (_c("s_copied") == 0)), "s_copied")
_flag("h35_flag_checked", "!Chk", "(0.7 * s_new * max_checked / max_new > s_checked AND max_checked > 5) OR (max_checked > 50 AND s_checked = 0)", lambda: ((0.7 * _c("s_new") * _c("max_checked") / _c("max_new") > _c("s_checked")) & (_c("max_checked") > 5)) | ((_c("max_checked") > 50) & (_c("s_checked") == 0)), "s_checked")
_flag("h36_flag_deleted", "!Del", "age > 86400 * 2 AND s_deleted < 0.25 * s_checked AND s_checked > 4", lambda: (_c("age") > 86400 * 2) & (_c("s_deleted") < 0.25 * _c("s_checked")) & (_c("s_checked") > 4), "s_deleted")


@query("h37_orphan_counts", f"WITH {INFO} SELECT hostname, count(*) FILTER (status = -1) AS n_created, count(*) FILTER (status = 0) AS n_injected, count(*) FILTER (status = 1) AS n_new, round(coalesce(sum(filesize), 0) / 1048576, 5) AS mb FROM info WHERE status IN (-1, 0, 1) GROUP BY ROLLUP (hostname)", **ALL)
def orphan_counts(*t):
    o = books.orphan_counts(info_of(*t), [-1, 0, 1])
    return o.withColumn("mb", F.round("mb", 5))


@query("h38_file_status_report", f"WITH {INFO} SELECT file_key, status FROM info WHERE epoch({T}) - epoch(ctime) > 86400 * 200 AND contains(filename, '.0003.')", **ALL)
def status_report(*t):
    from ..sources.logs import file_list_filter

    return file_list_filter(info_of(*t), now(), 200, ".0003.").select("file_key", "status")


_POLICY = "(VALUES (50, 86400 * 1000), (80, 86400 * 400), (95, 86400 * 100)) p(percent, a)"


@query("h39_retention_candidates", f"WITH i AS (SELECT file_key, ctime, file_key % 100 AS pc FROM files_created), j AS (SELECT file_key, ctime, arg_max(p.a, p.percent) AS lim FROM i, {_POLICY} WHERE p.percent <= i.pc GROUP BY ALL) SELECT file_key, CAST(lim AS BIGINT) AS limit_s FROM j WHERE epoch({T}) - epoch(ctime) > lim", fc="files_created")
def retention(fc):
    pol = fc.sparkSession.sql("SELECT percent, CAST(a AS BIGINT) AS max_age_s FROM VALUES (50, 86400 * 1000), (80, 86400 * 400), (95, 86400 * 100) AS p(percent, a)")
    return books.retention_candidates(fc.select("file_key", "ctime", (F.col("file_key") % 100).alias("percent")), pol, now()).select("file_key", "limit_s")


@query("h40_max_disk_percent", "SELECT hostname AS host, max(file_key % 100) AS disk_full, max(runnumber) AS runnumber FROM files_created GROUP BY 1", fc="files_created")
def disk_percent(fc):
    return books.max_disk_percent(fc.select(F.col("hostname").alias("host"), (F.col("file_key") % 100).alias("percent")), fc.select(F.col("hostname").alias("host"), "runnumber"))


@query("k1_time_diff", f"SELECT file_key, CAST(epoch({T}) - epoch(ctime) AS BIGINT) AS d FROM files_created", fc="files_created")
def diff(fc):
    return fc.select("file_key", time_diff(F.col("ctime"), now()).alias("d"))


@query("k2_tochards", f"WITH s AS (SELECT file_key, CAST(epoch({T}) - epoch(ctime) AS BIGINT) + file_key % 86400 AS s FROM files_created) SELECT file_key, CAST(s // 86400 AS VARCHAR) AS ddd, lpad(CAST(s // 3600 % 24 AS VARCHAR), 2, '0') AS hh, CAST(s // 60 AS VARCHAR) AS mmm, lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS ss FROM s", fc="files_created")
def tochards(fc):
    s = secs(now()) - secs("ctime") + F.col("file_key") % 86400
    return fc.select("file_key", *(duration_text(s, m).alias(m.lower()) for m in ("DDD", "HH", "MMM", "SS")))


@query("k8_trans_rate_check", f"""WITH {INFO}, {_sum_sql('runnumber')}, w AS (SELECT runnumber, s_filesize / 1e5 / 3 AS w, s_filesize2t0 / 1e5 / 5 AS t, s_filesize / 1e6 AS gb, n_instance AS n, stop_write_s - start_write_s AS sp FROM sm)
 SELECT runnumber, CASE WHEN sp > 360 AND w > 0 AND t = 0 THEN 3 WHEN gb > 50 AND (CASE WHEN w < 20 THEN t < 0.1 * w ELSE (t + 5 < 0.75 * w AND t < 900 * n / 16) OR (t < 0.5 * w AND t < 800 * n / 16) END) THEN 2 ELSE 0 END AS rate_status FROM w""", **ALL)
def rate_check(*t):
    s = summed(["runnumber"], *t)
    return s.select("runnumber", st.trans_rate_check(_c("s_filesize") / 1e5 / 3, _c("s_filesize2t0") / 1e5 / 5, _c("s_filesize") / 1e6, _c("n_instance"), _c("stop_write_s") - _c("start_write_s")).alias("rate_status"))


@query("k9_deleted_check", f"""WITH {INFO}, {_sum_sql('runnumber')}, w AS (SELECT *, CASE WHEN runnumber % 2 = 0 THEN 1 ELSE 3 END AS hosts, epoch(DATE_TRUNC('day', {T})) - stop_trans_s AS late, stop_trans_s - start_write_s AS sp, abs(epoch({T}) - stop_trans_s) AS a, coalesce(s_deleted / nullif(s_checked, 0), 1.0) AS part FROM sm)
 SELECT runnumber, CASE WHEN s_deleted = s_checked OR s_deleted = s_repacked OR s_deleted = s_created THEN 0 WHEN hosts = 1 THEN CASE WHEN late > 62400 + 90000 THEN 3 WHEN late > 62400 THEN 2 ELSE 1 END
 WHEN a < 360 THEN CASE WHEN part < coalesce(1 - 25200 / nullif(sp, 0), 0) THEN 3 WHEN part < coalesce(1 - 20400 / nullif(sp, 0), 0) THEN 2 ELSE 1 END
 ELSE CASE WHEN s_deleted = s_repacked THEN 1 WHEN part < coalesce(1 - greatest(24000 + 25200 - a, 0) / nullif(sp, 0), 0) THEN 3 WHEN part < coalesce(1 - greatest(24000 + 6000 - a, 0) / nullif(sp, 0), 0) THEN 2 ELSE 1 END END AS deleted_status FROM w""", **ALL)
def deleted_check(*t):
    s = books.summary(info_of(*t), ["runnumber"])
    return s.select("runnumber", st.deleted_check(_c("s_deleted"), _c("s_checked"), _c("s_repacked"), _c("s_created"), F.when(_c("runnumber") % 2 == 0, 1).otherwise(3), _c("start_write_time"), _c("stop_trans_time"), now()).alias("deleted_status"))


@query("k10_notfiles_check2", f"WITH {INFO}, {_sum_sql('runnumber')}, w AS (SELECT runnumber, s_created - s_injected AS u, n_instance AS n, CASE WHEN n_instance > 1 THEN 0.25 ELSE 1.0 END AS f, {_AGE} AS age FROM sm) SELECT runnumber, CASE WHEN u = 0 THEN 0 WHEN u > 50 * (1 + f * n) THEN 3 WHEN u > 24 * (1 + f * n) THEN 2 WHEN age > 2700 THEN 3 WHEN age > 1800 THEN 2 ELSE 1 END AS notfiles_status FROM w", **ALL)
def notfiles2(*t):
    s = books.summary(info_of(*t), ["runnumber"])
    return s.select("runnumber", st.notfiles_check2(_c("s_created") - _c("s_injected"), _c("n_instance"), st.age(now(), _c("stop_write_time"))).alias("notfiles_status"))


@query("k11_notfiles_check", f"WITH {INFO}, {_sum_sql('runnumber')}, n AS (SELECT runnumber, count(DISTINCT stream) AS st FROM info GROUP BY 1), w AS (SELECT runnumber, s_created - s_injected AS u, st, epoch({T}) - stop_write_s AS a FROM sm JOIN n USING (runnumber)) SELECT runnumber, CASE WHEN (a > 2700 AND u > 0) OR (a < 2700 AND u > 5 * st + 5) THEN 2 WHEN (a > 1800 AND u > 0) OR (a < 1800 AND u > 3 * st + 5) THEN 1 ELSE 0 END AS notfiles_status FROM w", **ALL)
def notfiles(*t):
    i = info_of(*t)
    s = books.summary(i, ["runnumber"]).join(i.groupBy("runnumber").agg(F.countDistinct("stream").alias("streams")), "runnumber")
    return s.select("runnumber", st.notfiles_check(_c("s_created") - _c("s_injected"), _c("streams"), secs(now()) - secs("stop_write_time")).alias("notfiles_status"))


@query("k12_instance_check", f"WITH {INFO}, i AS (SELECT runnumber, setuplabel, instance, count(t_injected) AS closed FROM info GROUP BY ALL), r AS (SELECT runnumber, setuplabel, count(*) AS n, max(closed) AS mc FROM i GROUP BY ALL), p AS (SELECT *, lag(n) OVER (PARTITION BY setuplabel ORDER BY runnumber) AS pn FROM r) SELECT runnumber, CASE WHEN n = 0 THEN 2 WHEN mc > 5 AND n <> pn THEN 1 ELSE 0 END AS instance_status FROM p".replace("mc > 5", "mc > 25"), **ALL)
def instance_check(*t):
    i = info_of(*t).groupBy("runnumber", "setuplabel", "instance").agg(F.count("t_injected").alias("closed"))
    r = books.previous_same_label(i.groupBy("runnumber", "setuplabel").agg(F.count("*").alias("n"), F.max("closed").alias("mc")))
    return r.select("runnumber", st.instance_check(_c("mc"), _c("n"), _c("previous_n"), F.lit(False)).alias("instance_status"))


@query("k15_na_or_round", "SELECT file_key, CASE WHEN file_key % 5 = 0 THEN 'NA' ELSE CAST(file_key % 5 AS VARCHAR) END AS v FROM files_created", fc="files_created")
def na(fc):
    return fc.select("file_key", st.na_or_round(F.col("file_key") % 5, 0).alias("v"))


@query("k16_date_texts", "SELECT file_key, strftime(ctime, '%d/%m/%Y:%H/%M/%S') AS stamp, strftime(ctime, '%H:%M:%S') AS clock, strftime(ctime, '%Y%m%d') AS day FROM files_created", fc="files_created")
def dates(fc):
    return fc.select("file_key", *(c.alias(n) for n, c in date_texts(F.col("ctime")).items()))


@query("k18_index_name", "SELECT file_key, regexp_replace(filename, '\\.dat$', '.ind') AS name FROM files_created", fc="files_created")
def index_names(fc):
    return fc.select("file_key", st.index_name(F.col("filename")).alias("name"))


@query("k19_join_limited", "SELECT runnumber, array_to_string(list_sort(list(DISTINCT stream))[1:3], ', ') || CASE WHEN count(DISTINCT stream) > 3 THEN ', ...' ELSE '' END AS streams FROM files_created GROUP BY 1", fc="files_created")
def limited(fc):
    return fc.groupBy("runnumber").agg(F.array_sort(F.collect_set("stream")).alias("s")).select("runnumber", st.join_limited(F.col("s"), 3).alias("streams"))


@query("k20_trim_escape", "SELECT file_key, replace(trim(concat(' ', stream, '&', hostname, ' '), ' '), '&', '&amp;') AS v FROM files_created", fc="files_created")
def trimmed(fc):
    return fc.select("file_key", st.escape_amp(st.trim_spaces(F.concat(F.lit(" "), "stream", F.lit("&"), "hostname", F.lit(" ")))).alias("v"))


@query("k21_selection_help", "SELECT output_module_label, 'Output module ' || output_module_label || ': ' || string_agg(DISTINCT CAST(broker_id AS VARCHAR), ', ' ORDER BY CAST(broker_id AS VARCHAR)) AS help FROM daq_events GROUP BY 1", ev="daq_events")
def help_text(ev):
    g = ev.groupBy("output_module_label").agg(F.array_sort(F.collect_set(F.col("broker_id").cast("string"))).alias("n"))
    return g.select("output_module_label", st.selection_help(F.col("output_module_label"), F.col("n")).alias("help"))


@query("k22_duration_seconds", "SELECT event_number, floor(data_size / 7) / 1000 AS s FROM daq_events", ev="daq_events")
def durations(ev):
    return ev.select("event_number", duration_seconds(F.col("data_size") / 7).alias("s"))
