"""Streams over several micro-batches: state and watermarks carried from file to file."""

from __future__ import annotations

import functools
import os
from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import same_rows
from pyspark.sql import functions as F
from spark_runbook.operators.assembly import KEY
from spark_runbook.plans import registry
from spark_runbook.sources import logs
from spark_runbook.streaming import event_time as et
from spark_runbook.streaming import stateful as ss

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def table_of(spark, path, schema, batches):
    """A table of one part file a batch, read back as a stream in this order, a file a batch."""
    os.makedirs(path / "t.parquet")
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r[:-1], START + timedelta(seconds=r[-1])) for r in rows], schema).toPandas().to_parquet(name := path / "t.parquet" / f"part-{i}.parquet", coerce_timestamps="us")
        os.utime(name, (1_700_000_000 + 60 * i,) * 2)
    return ss.read_table(spark, str(path), "t").withColumn("arrival", F.col("arrival").cast("timestamp"))


def test_ready_over_batches(spark, tmp_path):
    """Later files may hold earlier times: rows are taken in order of time all the same."""
    up = table_of(spark, tmp_path, "run_number long, lumi_section long, top_folder string, arrival timestamp", [
        [(1, 1, "A", 60), (1, 1, "A", 61), (1, 1, "C", 60)],
        [(1, 1, "D", 1000), (1, 1, "D", 1001), (1, 1, "D", 1300)],
        [(1, 1, "A", 0), (1, 1, "A", 1), (1, 1, "B", 0)],
    ])
    out = et.ended(up, "arrival", "1 hour", lambda m: et.ordered_fold(m, ["run_number", "lumi_section", "top_folder"], "arrival", et.Ready(3)))
    assert sorted((r.top_folder, r.n, r.reason) for r in out.collect()) == [("A", 3, "complete"), ("B", 1, "timeout"), ("C", 1, "timeout"), ("D", 1, "timeout"), ("D", 2, "timeout")]


FRAGMENTS = "code int, run_number long, event_number long, secondary_id long, originator_pid long, originator_guid long, frame_index int, num_frames int, data_size long, arrival timestamp"


def test_assembly_over_batches(spark, tmp_path):
    def part(event, index, at, frames=2):
        return (1, 1, event, 1, 1, 1, index, frames, 10 + index, at)

    batches = [[part(1, 1, 30), part(2, 1, 0)], [part(1, 0, 0), part(4, 0, 5), part(4, 0, 6), part(4, 1, 7)], [part(3, 0, 1000), part(1, 0, 40), part(5, 0, 0, 1), part(5, 0, 1, 1), part(6, 0, 0), part(6, 1, 60)]]
    assert set(KEY) <= set(FRAGMENTS.replace(",", "").split())
    forced = 0x80 | 0x10000
    want = [(1, 1, 10, False, forced), (1, 2, 21, True, 0), (2, 1, 11, False, forced), (3, 1, 10, False, forced), (4, 3, 31, False, forced | 0x40), (5, 1, 10, True, 0), (5, 1, 10, True, 0), (6, 1, 10, False, forced), (6, 1, 11, False, forced)]
    for i, order in enumerate((batches, batches[::-1], [sum(batches, [])])):
        fr = table_of(spark, tmp_path / str(i), FRAGMENTS, order)
        out = et.ended(fr, "arrival", "1 hour", lambda m: et.ordered_fold(m, KEY, "arrival", et.Assembly(60_000)))
        assert sorted((r.event_number, r.n_fragments, r.event_size, r.complete, r.fault_bits) for r in out.collect()) == want


def test_put_out_before_the_end(spark, tmp_path):
    """With a delay of ten seconds, events are out as soon as the watermark has passed, not at the run's end only."""
    row = lambda e, at: (1, 1, e, 1, 1, 1, 0, 1, 5, at)
    fr = table_of(spark, tmp_path, FRAGMENTS, [[row(1, 0)], [row(2, 100)], [row(3, 200)]])
    seen = []
    et.ended(fr, "arrival", "10 seconds", lambda m: et.ordered_fold(m, KEY, "arrival", et.Assembly()), lambda df, i: seen.append((i, [r.event_number for r in df.collect()])))
    out = [(i, n) for i, ns in seen for n in ns]
    assert [n for _, n in out] == [1, 2, 3] and out[0][0] < out[1][0] < out[2][0]


def spread(src: Path, dst: Path, files: int, rows: int) -> None:
    """The table's first rows in so many files, rows and files in random order."""
    t = pq.read_table(src).slice(0, rows)
    at = np.random.default_rng(files).permutation(t.num_rows)
    dst.mkdir(parents=True)
    for i, part in enumerate(np.array_split(at, files)):
        pq.write_table(t.take(part), name := dst / f"part-{i:03}.parquet")
        os.utime(name, (1_700_000_000 + i * 7919 % 1009,) * 2)


@pytest.mark.parametrize("files", [1, 3, 50])
@pytest.mark.parametrize("name", ["l1_assemble_stream", "l5_drop_old_lumis", "l6_close_on_lumi_end", "l11_dqm_ready", "f1_stream_collate", "f9_stream_purge"])
def test_any_layout(spark, sf, tmp_path, monkeypatch, name, files):
    """The same rows whatever files the table is cut into, and in which order they come."""
    table = "events" if name.startswith("l6") else "lineitem"
    spread(Path(sf) / f"{table}.parquet", tmp_path / f"{table}.parquet", files, 600)
    monkeypatch.setattr(ss, "read_table", functools.partial(ss.read_table, files_a_batch=max(1, files // 4)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same_rows(registry.queries()[name](spark, str(tmp_path)), con, registry.oracle_sql()[name])


def test_state_store_setting_stays(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with et.state_in_rocksdb(spark):
        assert "RocksDB" in spark.conf.get(name)
    assert spark.conf.get(name) == before


def test_insert_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "s", 2), (1, "b", "s", 1), (2, "c", None, 1), (3, "d", "s", 1), (None, "e", "s", 1)], "k int, name string, stream string, n int")
    book = spark.createDataFrame([(3,)], "k int")
    new = logs.insert_files(rows, book, ["k", "name", "stream", "n"], "k", ["n"], "P")
    logs.append_files(new, path := str(tmp_path / "book"))
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, "b", "s", 1, "P")]
    assert logs.insert_files(rows, spark.read.parquet(path).select("k").union(book), ["k", "name", "stream", "n"], "k", ["n"], "P").count() == 0
