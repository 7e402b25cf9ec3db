"""Ordered scans over ranges, and null keys."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from spark_runbook.operators import files, ordered, selection, stats
from spark_runbook.streaming import stateful


@pytest.fixture(scope="module")
def rows(spark):
    """Keys of 1, 40 and 700 rows and 300 of a null key, with null values and null orders."""
    n = lambda i: i * 7919 % 104_729
    data = [(k, None if i == 3 and k == "b" else n(i), None if i % 5 == 0 else n(i * 3) % 50, f"p{i}") for k, m in (("a", 1), ("b", 40), ("c", 700), (None, 300)) for i in range(m)]
    return spark.createDataFrame(data, "k string, o long, v long, payload string").repartition(5), data


@pytest.mark.parametrize("chunks", [1, 7, 23])
def test_scan(rows, chunks):
    df, data = rows
    v = F.col("v")
    out = ordered.scan(df, ["k"], ["o"], chunks, s=("sum", v, True), n=("count", v, False), hi=("max", v, False), lo=("min", v, True), known=("last", v, True), before=("last", v, False))
    assert out.columns == ["k", "o", "v", "payload", "s", "n", "hi", "lo", "known", "before"]
    want = []
    for key in ("a", "b", "c", None):
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, r[1]))
        for i, r in enumerate(mine):
            past, now = ([x[2] for x in mine[:j] if x[2] is not None] for j in (i, i + 1))
            want.append((*r, sum(now) if now else None, len(past), max(past, default=None), min(now, default=None), now[-1] if now else None, past[-1] if past else None))
    key = lambda r: (str(r[0]), r[3])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_no_window_over_a_key(rows):
    """Windows of a scan are within a range, or over one row a range."""
    plan = selection.drop_old_lumis(rows[0].selectExpr("k AS run_number", "v AS lumi_section", "o"), 4, ["o"])._jdf.queryExecution().optimizedPlan().toString()
    inner = [line for line in plan.splitlines() if "Window [" in line]
    assert inner and all("__part" in line for line in inner)


def test_prescale_null_group(spark):
    df = spark.createDataFrame([(g, i) for i in range(20) for g in ("a", None)], "g string, o long")
    got = selection.prescale(df, 5, ["g"], ["o"], 3).collect()
    assert sorted((r.g or "", r.o) for r in got) == [(g, o) for g in ("", "a") for o in (4, 9, 14, 19)]


def test_statistics_of_null_keys(spark):
    df = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, s), 2.0) for k in ("a", None) for s in (0, 1, 4)], "k string, ts timestamp, v double")
    for f in (lambda: stats.quantity_recent(df, ["k"], "ts", "v", 1, 3), lambda: stats.binned_history(df, ["k"], "ts", "v", 1)):
        got = [[tuple(r)[1:] for r in f().where(key).orderBy("t").collect()] for key in ("k = 'a'", "k IS NULL")]
        assert got[0] == got[1] and sum(r[1] for r in got[0]) >= 3
    b = {r.k: tuple(r)[1:] for r in stats.bandwidth(df, ["k"], "ts", "v", 1).collect()}
    assert b["a"] == b[None] == (5, 1.2, 0.0, 2.0, 2.0)
    u = stats.unwanted_by_module(spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, s)) for k in ("m", None) for s in (0, 2)], "output_module_label string, creation_time timestamp"), 1, 0).collect()
    assert sorted((r.output_module_label or "", r.n, r.alarm) for r in u) == [(k, n, a) for k in ("", "m") for n, a in ((0, "clear"), (1, "raise"), (1, "raise"))]


def test_reports_of_null_keys(spark):
    f = spark.createDataFrame([(1, 1, "A"), (1, 2, None), (None, 1, "A"), (None, None, "B")], "runnumber long, lumisection long, stream string")
    e = spark.createDataFrame([(1, 1), (None, None)], "runnumber long, lumisection long")
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, files.end_of_lumi_report(f, e).collect()), key=key) == sorted([
        (1, 1, "A", 1, 1), (1, 1, None, 0, 1), (1, 2, "A", 0, 0), (1, 2, None, 1, 0), (None, 1, "A", 1, 0), (None, 1, "B", 0, 0), (None, None, "A", 0, 1), (None, None, "B", 1, 1)], key=key)
    assert sorted(map(tuple, files.unreported_lumis(f, e).collect()), key=str) == sorted([(1, 2), (None, 1)], key=str)
    assert sorted((tuple(r) for r in files.end_of_run_report(f, e).select("runnumber", "eols_count").collect()), key=str) == [(1, 1), (None, 0)]


def test_alarms_of_null_brokers(spark):
    ev = spark.createDataFrame([(1, True), (None, False), (None, True)], "broker_id int, faulty boolean")
    dis = spark.createDataFrame([(1, 0), (1, 9), (None, 0), (5, 0)], "broker_id int, code int")
    known = spark.createDataFrame([(1,), (2,), (None,)], "broker_id int")
    got = {r.broker_id: (r.faulty_events, r.ignored_discards, r.faulty_alarm, r.ignored_discard_alarm) for r in stats.sender_alarms(ev, dis, known, [0]).collect()}
    assert got == {1: (1, 1, "raise", "raise"), 2: (0, 0, "revoke", "revoke"), None: (1, 0, "raise", "revoke"), 5: (0, 1, "revoke", "raise")}
    kinds = dis.withColumn("kind", F.lit("x"))
    assert {(r.why, r.n) for r in stats.skipped_discards(kinds, known, [0]).collect()} == {("unknown_broker", 1), ("invalid_code", 1)}


def test_discards_and_levels_over_ranges(spark):
    rows = spark.createDataFrame([(c, i, "dropped" if i % 4 else "served") for c in (1, None) for i in range(1, 400)], "c int, o int, outcome string")
    got = [tuple(r) for r in stats.discard_totals(rows, ["c"], ["o"]).select("c", "o", "dropped_before").collect()]
    assert len(got) == 198 and {x[2] for x in got} == {3}
    disk = spark.createDataFrame([(p, i, u, 100, False) for p in ("d", None) for i, u in enumerate([10, 91, 87, 86, 85, 88, 95])], "path string, ts int, used int, size int, important boolean")
    level = {(r.path, r.ts): r.level for r in stats.disk_usage(disk).collect()}
    assert [level["d", i] for i in range(7)] == [level[None, i] for i in range(7)] == ["OKAY", "WARNING", "WARNING", "WARNING", "OKAY", "OKAY", "WARNING"]


def test_expiry_over_ranges(spark):
    rows = spark.createDataFrame([(c, "poll" if i % 50 == 10 else "event", i, i * 10) for c in ("x", None) for i in range(300)], "consumer string, kind string, seq long, t long")
    got = {(r.consumer, r.seq) for r in stateful.consumer_expiry(rows, 300).where("stale").collect()}
    assert got == {(c, i) for c in ("x", None) for i in range(300) if i * 10 - max((p * 10 for p in range(i + 1) if p % 50 == 10), default=0) > 300}
