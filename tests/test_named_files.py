"""Named files: written by tasks, a folder each, and checked by tasks."""

from __future__ import annotations

import glob
import os
import zlib

import duckdb
import pytest
from conftest import same_rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from spark_runbook.plans import registry
from spark_runbook.sources import logs
from spark_runbook.sources.named_files import NamedFiles, checksums

D5 = "d5_file_checksums"


def written(rows, path):
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.write.format("named_files").mode("append").save(path)


def test_written_and_read(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit("f"), F.col("id") % 500).alias("name"), "id", F.concat("id", F.lit("é\n")).alias("data"))
    written(rows.repartition(3, "name").sortWithinPartitions("name", "id").select("name", "data"), str(tmp_path))
    assert len(os.listdir(tmp_path)) <= 3
    want = {f"f{k}": "".join(f"{i}é\n" for i in range(k, 30_000, 500)).encode() for k in range(500)}
    found = glob.glob(f"{tmp_path}/*/*")
    assert len(found) == 500 and {os.path.basename(x): open(x, "rb").read() for x in found} == want
    got = checksums(spark, f"file://{tmp_path}/*").collect()
    assert len(got) == 500 and {os.path.basename(r.file): r.adler32 for r in got} == {k: zlib.adler32(v) for k, v in want.items()}


def test_nothing_and_unsorted(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(n, b"1") for n in x], "name string, data binary").coalesce(1)
    written(rows(), f"{tmp_path}/none")
    assert checksums(spark, f"{tmp_path}/none/*").count() == 0
    with pytest.raises(PySparkException, match="sorted by name"):
        written(rows("b", "a", "b"), f"{tmp_path}/bad")
    assert checksums(spark, f"{tmp_path}/bad/*").count() == 0


def test_folders(spark, tmp_path):
    """Files, empty and large ones too, of partition folders and of patterns; hidden ones aren't read."""
    big = os.urandom(3 << 20)
    for at, data in (("r=1/b=1/x.dat", b"abc"), ("r=1/b=2/x.dat", b""), ("r=2/b=1/y.dat", big), ("r=2/b=1/.y.dat.crc", b"1"), ("_temporary/z.dat", b"1"), ("other/z.dat", b"1")):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(data)
    book = spark.createDataFrame([("r=1/b=1/x.dat", zlib.adler32(b"abc")), ("r=1/b=2/x.dat", 1), ("r=2/b=1/y.dat", 5), ("r=3/b=1/y.dat", 5)], "name string, adler32 long")
    want = {("r=1/b=1/x.dat", zlib.adler32(b"abc"), True, True), ("r=1/b=2/x.dat", 1, True, True), ("r=2/b=1/y.dat", zlib.adler32(big), False, True), ("r=3/b=1/y.dat", None, False, False)}
    for path in (f"{tmp_path}", f"{tmp_path}/r=*/b=*", f"{tmp_path}/r=*/*/*.dat"):
        got = logs.file_checksums(spark, path, book, 3).collect()
        assert len(got) == 4 and {tuple(r) for r in got} == want


def test_query_folders(spark, sf):
    """A folder a task, however many files there are."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{base}/sink-*"))
    n = registry.queries()[D5](spark, sf).count()
    (sink,) = set(glob.glob(f"{base}/sink-*")) - before
    folders = [d for d, _, _ in os.walk(sink) if d != sink]
    assert len(folders) <= 4 and len(glob.glob(f"{sink}/*/*")) == n - 1 > len(folders)


def test_query_nulls(spark, tmp_path):
    """A fragment without a size has no line, and a block of such has no file, as in SQL."""
    rows = [(k, 1, None if k in (7, 2001) else float(k % 50), 1.0) for k in (3, 7, 13, 17, 1005, 2001, 2002)] + [(3, 2, 9.0, 1.0), (17, 2, None, 1.0), (None, 1, 2.0, 1.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double").withColumn("l_shipdate", F.lit("1998-01-01").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same_rows(registry.queries()[D5](spark, str(tmp_path)), con, registry.oracle_sql()[D5])
