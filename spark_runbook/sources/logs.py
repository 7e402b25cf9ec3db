"""Text sources: file logs, lumi logs, notification logs, status pages and inventories, parsed with SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of log lines and the columns they become.
RENAMED = {"COUNT": "FILECOUNTER", "DATASET": "SETUPLABEL"}
NOTIFY_RENAMED = {"APP": "PRODUCER", "APPVERSION": "APP_VERSION", "DATASET": "SETUPLABEL", "RUN": "RUNNUMBER"}
LUMI_FIXED = ["Timestamp", "run", "host", "instance", "LS", "EoLS", "kind", "LScount", "EoLScount", "LastLumi"]
FILE_KINDS = {"streamer": "Global", "edm": "Global", "lumi": "Global", "lumi-sa": "Global", "dqm": "Global", "pixdmp": "Global"}


def read_messages(spark: SparkSession, path: str, stream: bool = False, schema=None) -> DataFrame:
    """Fragments from a folder of Parquet files, as a table or as a stream."""
    return spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)


def write_streams(df: DataFrame, path: str) -> None:
    """A folder per stream, run and lumi section. Rows meet by these before they are written, so a section has few files; adaptive execution
    splits what is too large for one task."""
    cols = ["stream", "run_number", "lumi_section"]
    df.hint("rebalance", *cols).write.mode("append").partitionBy(*cols).parquet(path)


def write_errors(df: DataFrame, path: str) -> None:
    """Raw payloads of error events by run, without a header."""
    df.where("message_code = 'ERROR_EVENT'").select("run_number", "event_number", "payload").write.mode("append").partitionBy("run_number").parquet(path)


def file_checksums(spark: SparkSession, path: str, book: DataFrame, depth: int = 1) -> DataFrame:
    """Files of a folder against the book: name, adler32, matches, present. book: name (the last ``depth`` parts of the path), adler32 (0: not checked).

    Files that aren't booked match; booked files that aren't there don't. An empty file has the checksum of nothing, 1. Tasks list and read the
    files (``named_files``)."""
    from .named_files import checksums

    f = checksums(spark, path).select(F.substring_index("file", "/", -depth).alias("name"), "adler32").withColumn("present", F.lit(True))
    b = book.select("name", F.col("adler32").alias("__b"))
    matches = F.coalesce(F.col("present"), F.lit(False)) & (F.coalesce(F.col("__b"), F.lit(0)).isin(0) | (F.col("__b") == F.col("adler32")))
    return f.join(b, "name", "full").select("name", "adler32", matches.alias("matches"), F.coalesce("present", F.lit(False)).alias("present"))


def write_faulty(df: DataFrame, path: str, run: int) -> None:
    """Faulty events in a folder of their own; without header fields they go to the given run and section 0."""
    ok = F.col("header_ok")
    df.where("faulty").withColumn("run_number", F.when(ok, F.col("run_number")).otherwise(F.lit(run))).withColumn("lumi_section", F.when(ok, F.col("lumi_section")).otherwise(F.lit(0))).write.mode("append").partitionBy("run_number", "lumi_section").parquet(path)


def _options(line: Column, pattern: str, renamed: dict[str, str]) -> Column:
    keys = F.transform(F.regexp_extract_all(line, F.lit(pattern), 1), lambda k: F.replace(k, F.lit("_"), F.lit("")))
    for a, b in renamed.items():
        keys = _renamed(keys, a, b)
    return F.map_from_arrays(keys, F.regexp_extract_all(line, F.lit(pattern), 2))


def _renamed(keys: Column, a: str, b: str) -> Column:
    return F.transform(keys, lambda k: F.when(k == a, F.lit(b)).otherwise(k))


def parse_file_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of the file log: action, args (map) and rejected (an odd number of words behind the action)."""
    v = F.trim(F.col(value))
    words = F.filter(F.split(F.regexp_replace(v, r"^\S+\s*", ""), r"\s+"), lambda w: w != "")
    action = F.regexp_extract(v, r"^\./(\w+)\.pl", 1)
    return lines.select(value, action.alias("action"), _options(v, r"--(\w+)\s+(\S+)", RENAMED).alias("args"), ((F.size(words) % 2 == 1) | (action == "")).alias("rejected"))


def parse_lumi_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tab-separated key:value lines: m (map), kind of BoR, EoR or EoLS, rejected when a needed key is missing."""
    m = F.str_to_map(F.col(value), F.lit("\t"), F.lit(":"))
    kind = F.when(F.contains(F.col(value), F.lit("BoR")), "BoR").when(F.contains(F.col(value), F.lit("EoR")), "EoR").otherwise("EoLS")
    need = [F.element_at(m, k).isNull() for k in ("Timestamp", "run", "instance", "host")]
    return lines.select(value, m.alias("m"), kind.alias("kind"), (need[0] | need[1] | need[2] | need[3]).alias("rejected"))


def unpivot_lumi_counts(parsed: DataFrame) -> DataFrame:
    """End-of-lumi lines to a row per stream key."""
    counts = F.map_filter("m", lambda k, _: ~k.isin(LUMI_FIXED))
    e = lambda k: F.element_at("m", k).cast("long")
    return parsed.where((F.col("kind") == "EoLS") & ~F.col("rejected")).select(e("run").alias("run"), e("LS").alias("lumi"), e("instance").alias("instance"), F.coalesce(e("EoLS"), F.lit(0)).alias("eols"), F.explode(counts).alias("stream", "filecount")).withColumn("filecount", F.col("filecount").cast("long"))


def parse_notify_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines ``[date] INFO name.pl --K=V ..`` to date and args."""
    v = F.col(value)
    return lines.select(value, F.regexp_extract(v, r"^\[([^\]]*)\]", 1).alias("date"), _options(v, r"--(\w+)=(\S+)", NOTIFY_RENAMED).alias("args"))


def notify_records(files: DataFrame, columns: list[str]) -> DataFrame:
    """Outgoing records of closed files as JSON; streams that aren't told of are left out."""
    return files.where(~F.col("stream").endswith("_DontNotifyT0")).select("file_key", F.to_json(F.struct(*columns)).alias("record"))


def file_inventory(names: DataFrame, name: str = "filename") -> DataFrame:
    """Names ``label.run.lumi.app.instance.n.dat`` to counts by label, run and instance."""
    part = lambda i: F.regexp_extract(F.col(name), r"^([^.]+)\.(\d+)\..*\.(\d+)\.\d+\.dat$", i)
    f = names.where(~F.col(name).contains("EcalCalibration") & (part(1) != ""))
    return f.groupBy(part(1).alias("label"), part(2).cast("long").alias("run"), part(3).cast("long").alias("instance")).agg(F.count("*").alias("n_files"))


def storage_page_status(html: Column) -> Column:
    """Score of a controller's page: 1 for a failed disk, 100 for a failed controller, 1000 for other failures."""
    found = F.regexp_extract_all(html, F.lit(r">([^<>]*) has failed"), 1)
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.when(F.lower(x).contains("disk"), 1).when(F.lower(x).contains("controller"), 100).otherwise(1000))


def reject_incomplete(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others."""
    missing = F.exists(F.array(*(F.col(c).isNull() for c in required)), lambda x: x)
    return df.where(~missing), df.where(missing)


def insert_files(rows: DataFrame, book: DataFrame, columns: list[str], key: str, order: list[str], producer: str) -> DataFrame:
    """What a batch of parsed lines adds to the book: the chosen columns and the producer's name. Lines without one of the columns add nothing, of
    lines of one key the first in order counts, and keys that the book has stay as they are."""
    rest = [c for c in columns if c != key]
    whole = reject_incomplete(rows, columns)[0]
    first = whole.groupBy(key).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__r"))
    new = first.select(key, *(F.col(f"__r.{c}").alias(c) for c in rest), F.lit(producer).alias("producer"))
    return new.join(book.select(key), key, "left_anti")


def append_files(new: DataFrame, path: str) -> None:
    """Appends inserted rows to the book's folder."""
    new.write.mode("append").parquet(path)


def file_list_filter(inv: DataFrame, now: Column, days: int, text: str) -> DataFrame:
    from ..functions.times import secs

    return inv.where((secs(now) - secs("ctime") > days * 86400) & F.col("filename").contains(text))


def validate_injection(df: DataFrame, hosts: list[str]) -> DataFrame:
    """rejected: no text, an unknown type, a host that isn't allowed, or a missing name; destination by type. df: type, filename, hostname, destination."""
    why = F.when(F.col("filename").isNull(), "no filename").when(~F.coalesce(F.col("type").isin(list(FILE_KINDS)), F.lit(False)), "unknown type").when(~F.coalesce(F.col("hostname").isin(hosts), F.lit(False)), "unknown host")
    default = F.element_at(F.create_map(*(F.lit(x) for kv in FILE_KINDS.items() for x in kv)), F.col("type"))
    return df.withColumn("rejected", why).withColumn("destination", F.coalesce("destination", default))
