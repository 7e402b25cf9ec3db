"""Frames: any payload comes back, from ranges of any size, and damage is rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from spark_runbook.sources import frames


def packed(spark, payloads):
    df = spark.createDataFrame([(1 + i % 5, i, p) for i, p in enumerate(payloads)], "code int, event_number long, payload binary")
    return [bytes(r.frame) for r in frames.pack(df).collect()]


def read(path, size):
    name, data = str(path), path.read_bytes()
    return [x for a in range(0, len(data), size) for x in frames.frames_in(frames.Bytes(name, a, min(a + size, len(data))), 16)]


@pytest.fixture(scope="module")
def payloads():
    rnd = random.Random(4)
    return [b"", b"\0", frames.SYNC, frames.SYNC[:3], frames.SYNC[:3] + b"\0\0", frames.SYNC * 3, *(bytes(rnd.choice([*frames.SYNC, 0, 7]) for _ in range(rnd.randrange(60))) for _ in range(60))]


@pytest.mark.parametrize("size", [1, 5, 33, 1000, 10**6])
def test_any_payload_and_range(spark, tmp_path, payloads, size):
    (tmp_path / "a.bin").write_bytes(b"".join(packed(spark, payloads)))
    got = read(tmp_path / "a.bin", size)
    assert [(f["event_number"], f["payload"], f["kind"]) for _, f, p in got if p is None] == [(i, p, frames.KINDS[1 + i % 5]) for i, p in enumerate(payloads)]
    assert len({at for at, _, _ in got}) == len(payloads)


@pytest.mark.parametrize("size", [7, 10**6])
def test_damage(spark, tmp_path, size):
    f = packed(spark, [b"one", b"two" * 30, b"three", b"four", b"five"])
    data = b"junk" + f[0] + f[1][:50] + bytes([f[1][50] ^ 1]) + f[1][51:] + f[2] + frames.SYNC + b"x" + f[3][:-2] + f[4]
    (tmp_path / "b.bin").write_bytes(data)
    assert [(x.get("payload"), p) for _, x, p in read(tmp_path / "b.bin", size)] == [(None, "no frame"), (b"one", None), (None, "checksum"), (b"three", None), (None, "short"), (None, "checksum"), (b"five", None)]
    (tmp_path / "c.bin").write_bytes(b"nothing here")
    assert [p for _, _, p in read(tmp_path / "c.bin", size)] == ["no frame"]


def test_unknown_kind(spark, tmp_path):
    df = spark.createDataFrame([(77, b"p")], "code int, payload binary")
    (tmp_path / "d.bin").write_bytes(bytes(frames.pack(df).first().frame))
    assert [(f["code"], p) for _, f, p in read(tmp_path / "d.bin", 100)] == [(77, "unknown kind")]


def test_write_and_read(spark, tmp_path):
    spark.dataSource.register(frames.Frames)
    df = spark.range(500).select(F.lit(2).alias("code"), F.col("id").alias("event_number"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
    for _ in range(2):
        frames.pack(df.repartition(3)).write.format("frames").mode("append").save(str(tmp_path / "f"))
    back = spark.read.format("frames").option("rangeBytes", 1000).load(str(tmp_path / "f"))
    assert back.where("problem IS NULL").groupBy("event_number").count().where("count = 2").count() == 500
    frames.pack(df.limit(5)).write.format("frames").mode("overwrite").save(str(tmp_path / "f"))
    assert spark.read.format("frames").load(str(tmp_path / "f")).count() == 5
    assert sorted(x.name[0] for x in (tmp_path / "f").iterdir()) == ["p"] * len(list((tmp_path / "f").iterdir()))


def test_small_ranges_are_few_tasks(spark, tmp_path):
    """tasks follow the bytes, not the number of ranges, and all ranges are read once."""
    spark.dataSource.register(frames.Frames)
    df = spark.range(3000).select(F.lit(2).alias("code"), F.col("id").alias("event_number"), F.lit(b"x" * 50).alias("payload"))
    frames.pack(df.repartition(3)).write.format("frames").mode("append").save(str(tmp_path / "f"))
    back = spark.read.format("frames").option("rangeBytes", 1000).load(str(tmp_path / "f"))
    assert back.select(F.spark_partition_id()).distinct().count() == 1
    assert back.where("problem IS NULL").select("event_number").distinct().count() == back.count() == 3000
