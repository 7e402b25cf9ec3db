"""The log tail: growth, restarts, truncation, replaced files, ranges and unfinished lines."""

from __future__ import annotations

import random

import pytest
from spark_runbook.sources.tail import LogTail, Tail


def run(spark, folder, out, state, range_bytes=64):
    spark.dataSource.register(LogTail)
    q = spark.readStream.format("log_tail").option("rangeBytes", range_bytes).load(str(folder)).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state))
    q.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(str(out)).collect()
    return sorted((r.file.rsplit("/", 1)[-1], r.offset, r.line) for r in rows if r.warning is None), sorted((r.file.rsplit("/", 1)[-1], r.warning) for r in rows if r.warning)


def test_tail_over_restarts(spark, tmp_path):
    """Each line once over runs of the query, whatever came between; a file that got shorter and one that was replaced are read anew, with a warning."""
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_bytes(b"one\ntwo\nthr")
    (logs / "_SUCCESS").write_bytes(b"no\n")
    go = lambda: run(spark, f"{logs}/*.log", tmp_path / "out", tmp_path / "state", 5)
    assert go() == ([("a.log", 0, "one"), ("a.log", 4, "two")], [])
    with a.open("ab") as f:
        f.write("ee é\n\nfive".encode())
    b.write_bytes(b"begin of b\nmore\n")
    lines = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "three é"), ("a.log", 17, ""), ("b.log", 0, "begin of b"), ("b.log", 11, "more")]
    assert go() == (lines, [])
    assert go() == (lines, [])
    a.write_bytes(b"new\n")
    assert go() == (sorted([*lines, ("a.log", 0, "new")]), [("a.log", "got shorter: 4 < 18")])
    b.write_bytes(b"another b that is longer\n")
    assert go() == (sorted([*lines, ("a.log", 0, "new"), ("b.log", 0, "another b that is longer")]), [("a.log", "got shorter: 4 < 18"), ("b.log", "begins otherwise than before")])


@pytest.mark.parametrize("size", [1, 2, 7, 64, 10_000])
def test_ranges_give_each_line_once(tmp_path, size):
    rnd = random.Random(size)
    lines = ["".join(rnd.choice("ab é\r") for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(60)]
    (tmp_path / "x.log").write_bytes("".join(f"{x}\n" for x in lines).encode() + b"open end")
    t = Tail(str(tmp_path), size)
    got = [(r["offset"], r["line"]) for part in t.ranges({}, t.state()) for b in t.lines(part) for r in b.to_pylist()]
    assert [x for _, x in got] == lines and [at for at, _ in got] == [len("".join(f"{x}\n" for x in lines[:i]).encode()) for i in range(60)]


def test_long_line_and_empty_folder(tmp_path):
    t = Tail(str(tmp_path / "none"))
    assert t.state() == {} and t.ranges({}, {}) == []
    (tmp_path / "y").write_bytes(b"x" * 3_000_000 + b"\nz\n" + b"w" * 2_500_000)
    t = Tail(f"file://{tmp_path}", 1 << 20)
    assert next(iter(t.state().values()))["end"] == 3_000_003
    got = [r["line"] for part in t.ranges({}, t.state()) for b in t.lines(part) for r in b.to_pylist()]
    assert [len(x) for x in got] == [3_000_000, 1]


def test_tail_as_a_table(spark, tmp_path):
    (tmp_path / "t.log").write_bytes(b"a\nb\n")
    spark.dataSource.register(LogTail)
    assert sorted(r.line for r in spark.read.format("log_tail").load(f"{tmp_path}/*.log").collect()) == ["a", "b"]
