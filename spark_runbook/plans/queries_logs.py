"""Queries over log texts, inventories and records (inventory group A). Lines are written from the tables by Spark and parsed again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import at, secs
from ..sources import logs
from .base import query


def _file_lines(fc, fi):
    j = fc.join(fi, "file_key")
    odd = F.when(F.col("file_key") % 17 == 0, F.lit(" stray")).otherwise("")
    return j.select("file_key", F.concat(F.lit("./closeFile.pl  --FILENAME "), "filename", F.lit(" --COUNT "), F.col("file_key") % 10, F.lit(" --N_EVENTS "), "nevents", F.lit(" --FILESIZE "), "filesize", F.lit(" --DATASET "), "setuplabel", odd).alias("value"))


@query("a6_parse_file_log", "SELECT filename, CAST(file_key % 10 AS BIGINT) AS filecounter, nevents, filesize, setuplabel FROM files_created JOIN files_injected USING (file_key) WHERE file_key % 17 <> 0", fc="files_created", fi="files_injected")
def file_log(fc, fi):
    p = logs.parse_file_log(_file_lines(fc, fi).select("value")).where(~F.col("rejected"))
    a = lambda k: F.element_at("args", k)
    return p.select(a("FILENAME").alias("filename"), a("FILECOUNTER").cast("long").alias("filecounter"), a("NEVENTS").cast("long").alias("nevents"), a("FILESIZE").cast("long").alias("filesize"), a("SETUPLABEL").alias("setuplabel"))


@query("a6_rejected_lines", "SELECT count(*) AS n FROM files_created JOIN files_injected USING (file_key) WHERE file_key % 17 = 0", fc="files_created", fi="files_injected")
def rejected(fc, fi):
    return logs.parse_file_log(_file_lines(fc, fi).select("value")).where("rejected").agg(F.count("*").alias("n"))


def _lumi_lines(fc):
    g = fc.groupBy("runnumber", "instance", "lumisection").agg(F.count_if(F.col("stream") == "A").alias("a"), F.count_if(F.col("stream") == "Express").alias("e"), F.min("hostname").alias("host"), F.min(secs("ctime")).alias("s"))
    line = F.concat(F.lit("Timestamp:"), "s", F.lit("\trun:"), "runnumber", F.when(F.col("lumisection") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("\thost:"), "host")), F.lit("\tinstance:"), "instance", F.lit("\tLS:"), "lumisection", F.lit("\tA:"), "a", F.lit("\tExpress:"), "e", F.when(F.col("lumisection") % 5 == 0, F.lit("")).otherwise("\tEoLS:1"))
    return g.select(line.alias("value"))


_LUMI = "g AS (SELECT runnumber AS run, instance, lumisection AS lumi, count(*) FILTER (stream = 'A') AS a, count(*) FILTER (stream = 'Express') AS e FROM files_created GROUP BY ALL)"


@query("a7_parse_lumi_log", "SELECT run, count(*) FILTER (lumi % 7 = 0) AS rejected, count(*) AS lines FROM (SELECT DISTINCT runnumber AS run, instance, lumisection AS lumi FROM files_created) GROUP BY 1", fc="files_created")
def lumi_log(fc):
    p = logs.parse_lumi_log(_lumi_lines(fc))
    return p.groupBy(F.element_at("m", "run").cast("long").alias("run")).agg(F.count_if("rejected").alias("rejected"), F.count("*").alias("lines"))


@query("a8_unpivot_lumi_counts", f"WITH {_LUMI} SELECT run, lumi, instance, CASE WHEN lumi % 5 = 0 THEN 0 ELSE 1 END::BIGINT AS eols, s AS stream, CASE s WHEN 'A' THEN a ELSE e END AS filecount FROM g, (VALUES ('A'), ('Express')) t(s) WHERE lumi % 7 <> 0", fc="files_created")
def unpivot(fc):
    return logs.unpivot_lumi_counts(logs.parse_lumi_log(_lumi_lines(fc)))


@query("h13_lumi_streams", f"WITH {_LUMI} SELECT run, s AS stream, CAST(sum(CASE s WHEN 'A' THEN a ELSE e END) AS BIGINT) AS files, CAST(sum(CASE WHEN lumi % 5 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS eols FROM g, (VALUES ('A'), ('Express')) t(s) WHERE lumi % 7 <> 0 GROUP BY ALL", fc="files_created")
def lumi_streams(fc):
    return logs.unpivot_lumi_counts(logs.parse_lumi_log(_lumi_lines(fc))).groupBy("run", "stream").agg(F.sum("filecount").alias("files"), F.sum("eols").alias("eols"))


@query("a9_parse_notify_log", "SELECT filename, runnumber, setuplabel, producer FROM files_created", fc="files_created")
def notify_log(fc):
    line = F.concat(F.lit("[2001-08-05 00:00:00] INFO notifyTier0.pl --FILENAME="), "filename", F.lit(" --RUN="), "runnumber", F.lit(" --DATASET="), "setuplabel", F.lit(" --APP="), "producer")
    a = lambda k: F.element_at("args", k)
    return logs.parse_notify_log(fc.select(line.alias("value"))).select(a("FILENAME").alias("filename"), a("RUNNUMBER").cast("long").alias("runnumber"), a("SETUPLABEL").alias("setuplabel"), a("PRODUCER").alias("producer"))


@query("a10_notify_records", "SELECT file_key, printf('{\"filename\":\"%s\",\"runnumber\":%d,\"stream\":\"%s\"}', filename, runnumber, stream) AS record FROM files_created WHERE NOT ends_with(stream, '_DontNotifyT0')", fc="files_created")
def notify(fc):
    return logs.notify_records(fc, ["filename", "runnumber", "stream"])


@query("a11_file_inventory", "SELECT setuplabel AS label, runnumber AS run, instance, count(*) AS n_files FROM (SELECT 'Data' AS setuplabel, runnumber, instance FROM files_created) GROUP BY ALL", fc="files_created")
def inventory(fc):
    return logs.file_inventory(fc.select("filename"))


@query("a12_insert_files", "WITH r AS (SELECT file_key, filename, CASE WHEN file_key % 11 <> 0 THEN stream END AS stream, runnumber, 1 AS attempt FROM files_created UNION ALL SELECT file_key, filename, stream, runnumber, 2 AS attempt FROM files_created WHERE file_key % 3 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY attempt) AS n FROM r WHERE stream IS NOT NULL) SELECT file_key, filename, stream, runnumber, attempt, 'Logger' AS producer FROM k WHERE n = 1 AND file_key NOT IN (SELECT file_key FROM files_created WHERE runnumber % 7 = 0)", fc="files_created")
def insert(fc):
    """A log that tells of some files twice and of some without a stream; the book has every seventh run already."""
    cols = ["file_key", "filename", "stream", "runnumber", "attempt"]
    once = fc.withColumn("stream", F.when(F.col("file_key") % 11 != 0, F.col("stream"))).withColumn("attempt", F.lit(1))
    again = fc.where("file_key % 3 = 0").withColumn("attempt", F.lit(2))
    return logs.insert_files(once.unionByName(again), fc.where("runnumber % 7 = 0"), cols, "file_key", ["attempt"], "Logger")


@query("a13_storage_page_status", "SELECT hostname, CAST(count(*) FILTER (file_key % 50 = 0) + 100 * count(*) FILTER (file_key % 50 = 1) + 1000 * count(*) FILTER (file_key % 50 = 2) AS BIGINT) AS score FROM files_created GROUP BY 1", fc="files_created")
def pages(fc):
    part = F.when(F.col("file_key") % 50 == 0, "<td>Disk 3 has failed</td>").when(F.col("file_key") % 50 == 1, "<td>Controller 1 has failed</td>").when(F.col("file_key") % 50 == 2, "<td>Fan has failed</td>").otherwise("<td>ok</td>")
    return fc.groupBy("hostname").agg(F.sum(logs.storage_page_status(part)).alias("score"))


@query("a14_reject_incomplete", "SELECT file_key FROM files_created LEFT JOIN files_injected USING (file_key) WHERE nevents IS NULL", fc="files_created", fi="files_injected")
def incomplete(fc, fi):
    return logs.reject_incomplete(fc.join(fi, "file_key", "left"), ["filename", "nevents"])[1].select("file_key")


@query("a15_file_list_filter", "SELECT file_key FROM files_created WHERE epoch(TIMESTAMP '2001-08-05 00:00:00') - epoch(ctime) > 86400 * 1000 AND contains(filename, '.0005.')", fc="files_created")
def listed(fc):
    return logs.file_list_filter(fc, at("2001-08-05 00:00:00"), 1000, ".0005.").select("file_key")


@query("a16_validate_injection", "SELECT file_key, CASE WHEN file_key % 4 = 3 THEN 'unknown type' WHEN hostname NOT LIKE 'srv-C2C06%' THEN 'unknown host' END AS rejected, CASE WHEN file_key % 4 <> 3 THEN 'Global' END AS destination FROM files_created", fc="files_created")
def validate(fc):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("streamer", "edm", "dqm", "other"))), (F.col("file_key") % 4 + 1).cast("int"))
    hosts = [f"srv-C2C06-{12 + i}" for i in range(16)]
    v = logs.validate_injection(fc.withColumn("type", kinds).withColumn("destination", F.lit(None).cast("string")), hosts)
    return v.select("file_key", "rejected", "destination")
