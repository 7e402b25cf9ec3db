"""Streams by event time at size: few micro-batches, combined rows, and folds against loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from spark_runbook.streaming import event_time as et
from spark_runbook.streaming import stateful as ss

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_many_files_are_one_micro_batch(spark, tmp_path):
    """F1: micro-batches are cut by bytes, so their number doesn't follow the number of files."""
    spark.range(30).repartition(30).write.parquet(str(tmp_path / "t.parquet"))
    seen = []
    stream = ss.read_table(spark, str(tmp_path), "t", bytes_a_batch=1 << 20)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(lambda df, i: seen.append(df.count())).start().awaitTermination()
    assert seen == [30]


def source(spark, path, schema, batches):
    """A stream of a file a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{i}"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


UPDATES = "run long, arrival timestamp, update_number long, sender long, folder string, object_name string, kind string, bin long, content long, entries long, w long, wy long, wyy long"


def collated(rows, expected, timeout_s, purge):
    """The updates of each run, one after the other."""
    out = []
    for run in {r[0] for r in rows}:
        state, last = None, None

        def put(reason):
            return [(run, state["n"], reason, *o, b, *x) for o, bins in state["objects"].items() for b, x in bins.items()]

        for u in sorted({(r[1], r[2], r[3]) for r in rows if r[0] == run}):
            if state and (u[0] - last).total_seconds() >= timeout_s:
                out += put("timeout") if state["n"] < expected else []
                state = None
            state, last = state or {"n": 0, "objects": {}}, u[0]
            state["n"] += 1
            if state["n"] > expected:
                continue
            new: dict = {}
            for r in rows:
                if r[0] == run and (r[1], r[2], r[3]) == u and r[6] in ("TH1", "TProfile"):
                    bins = new.setdefault((r[4], r[5], r[6]), {})
                    bins[r[7]] = [a + (b or 0) for a, b in zip(bins.get(r[7], [0] * 5), r[8:], strict=True)]
            for o, bins in new.items():
                if o not in state["objects"]:
                    state["objects"][o] = bins
                elif sum(x[1] for x in bins.values()) > 0:
                    for b, x in bins.items():
                        state["objects"][o][b] = [p + q for p, q in zip(state["objects"][o].get(b, [0] * 5), x, strict=True)]
            if state["n"] == expected:
                out += put("complete")
        if state and state["n"] < expected:
            out += [(run, state["n"], "discarded", *[None] * 9)] if purge else put("run ended")
    return sorted(out, key=str)


@pytest.mark.parametrize("purge", [False, True])
@pytest.mark.parametrize("delay", ["30 seconds", "20000 days"])
def test_collation_against_a_loop(spark, tmp_path, purge, delay):
    """folders that are complete, time out, begin anew and are open at the end, with several updates of one time, over several releases."""
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        t = rnd.choice([0, 1, 2, 3]) + 10 * rnd.randrange(40)
        for _ in range(rnd.randrange(1, 4)):
            rows.append((i % 3, START + timedelta(seconds=t), i // 2, i % 5, "f", rnd.choice("ab"), rnd.choice(["TH1", "TH1", "int"]), rnd.randrange(3), rnd.randrange(9), rnd.choice([0, 0, 3, None]), 1, 2, None))
    rows.sort(key=lambda r: r[1])
    stream = source(spark, tmp_path, UPDATES, [rows[:70], rows[70:150], rows[150:]])
    out = et.ended(stream, "arrival", delay, lambda m: et.Collate(m, ["run"], "arrival", 6, 25_000, purge))
    want = collated(rows, 6, 25, purge)
    got = sorted((tuple(r[c] for c in ("run", "n", "reason", *et.OBJECT, "bin", *et.SUMS)) for r in out.collect()), key=str)
    assert got == want and {r[2] for r in got} >= {"complete", "timeout"}


def test_rows_of_a_time_are_one(spark):
    """what waits for folders is a row a folder and time, whatever the number of updates."""
    up = spark.range(1000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") % 4).alias("arrival"))
    step = et.ordered_fold(up, ["k"], "arrival", et.Ready(7))
    assert sorted(r[et.COUNT] for r in step.combined(step.rows).collect()) == [250] * 4


def test_sections_wait_as_sums(spark):
    """what waits for ends is a row a section, and a late end closes all that came."""
    rows = [(1, 1, "A", "event", 5, START + timedelta(seconds=i)) for i in range(200)] + [(1, 1, None, "eols", None, START + timedelta(hours=1))]
    up = spark.createDataFrame(rows, "run_number long, lumi_section long, stream string, kind string, data_size long, at timestamp")
    step = et.CloseOnLumiEnd(up, ["A", "B"], "at")
    assert sorted((r.stream, r.n_events, r.bytes, r.ended) for r in step.combined(step.rows).collect()) == [("A", 0, 0, True), ("A", 200, 1000, False), ("B", 0, 0, True)]


def test_late_updates_over_releases(spark, tmp_path):
    """the largest section of a run goes on from one release to the next."""
    row = lambda at, lumi: (1, START + timedelta(seconds=at), lumi)
    stream = source(spark, tmp_path, "run_number long, arrival timestamp, lumi_section long", [[row(0, 9), row(1, 1)], [row(100, 2), row(101, 5)], [row(200, 4), row(201, 8)]])
    out = et.ended(stream, "arrival", "10 seconds", lambda m: et.DropOldLumis(m, 4, "arrival", ["arrival", "lumi_section"]))
    assert sorted(r.lumi_section for r in out.collect()) == [5, 8, 9]
