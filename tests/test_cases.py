"""Small hand-made cases: expressions, bits, checksums, statistics, rolls, buffers, pages."""

from __future__ import annotations

import math
import random
import re
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from spark_runbook.functions import status
from spark_runbook.functions.times import duration_text
from spark_runbook.operators import assembly, dqm, files, selection, stats
from spark_runbook.plans import registry
from spark_runbook.sources import logs
from spark_runbook.streaming import stateful

def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


PATHS = ["jet40", "jet80", "muonTight", "muonLoose", "photon", "minBias", "zeroBias"]


def random_rule(rnd, depth: int) -> tuple[str, str]:
    """An expression, and the same for Python over ``on``, the set of paths that passed."""
    kind = rnd.choice(["name", "name", "not", "and", "or", "brackets"]) if depth else "name"
    if kind == "name":
        name = rnd.choice([*PATHS, "jet*", "muon?????", "*Bias", "nosuch", "jet?", "*"])
        rule = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in name)
        return name, f"any(re.fullmatch({rule!r}, p) for p in on)"
    a, pa = random_rule(rnd, depth - 1)
    if kind == "not":
        return f"!({a})", f"(not ({pa}))"
    if kind == "brackets":
        return f"( {a} )", f"({pa})"
    b, pb = random_rule(rnd, depth - 1)
    word, own = rnd.choice([("&&", "and"), (".AND.", "and")] if kind == "and" else [("||", "or"), (".OR.", "or")])
    return f"({a}) {word} ({b})", f"(({pa}) {own} ({pb}))"


def test_expressions(spark):
    """Random expressions over random states (only 1 has passed), against Python."""
    rnd = random.Random(11)
    columns, want = [], []
    for i in range(60):
        expr, own = random_rule(rnd, 3)
        state = [rnd.randrange(4) for _ in PATHS]
        on = {p for p, x in zip(PATHS, state, strict=True) if x == 1}
        columns.append(selection.trigger_expr(expr, PATHS, F.array(*map(F.lit, state))).alias(f"x{i}"))
        want.append(eval(own, {"re": re, "on": on, "any": any}) or expr.strip() == "*")
    assert list(spark.range(1).select(*columns).first()) == want


@pytest.mark.parametrize(("expr", "want"), [("jet40 || photon && minBias", True), ("!photon && jet40", True), ("(jet40 || photon) && minBias", False), ("", True), ("  ", True), ("jet80", False), ("nosuch", False), ("!nosuch", True), ("jet*@ && !jet80", True)])
def test_binding(spark, expr, want):
    """Not binds most, then and, then or; blank is all."""
    states = F.array(*(F.lit(s) for s in (1, 3, 0, 2, 0, 3, 1)))
    assert one(spark, selection.trigger_expr(expr, PATHS, states)) is want


@pytest.mark.parametrize("expr", ["nosuch@", "(jet40", "jet40)", "jet40 ||", "&& jet40", "jet40 photon", "()", "!"])
def test_expression_errors(spark, expr):
    with pytest.raises(selection.SelectionError):
        selection.trigger_expr(expr, PATHS, F.array(F.lit(1)))


def test_bits(spark):
    """Two bits a path, low bits first, against plain arithmetic; and back."""
    rnd = random.Random(5)
    for n in (0, 1, 4, 7, 23):
        states = [rnd.randrange(4) for _ in range(n)]
        data = selection.encode_trigger_bits(states)
        assert int.from_bytes(data, "little") == sum(x << (2 * i) for i, x in enumerate(states)) and len(data) == -(-n // 4)
        assert one(spark, selection.decode_trigger_bits(F.lit(data), n)) == states


def test_shared_queues():
    c = [selection.Consumer("a", "m", unique=True), selection.Consumer("b", "m", unique=True), selection.Consumer("c", "m", prescale=2, unique=True), selection.Consumer("d", "m")]
    assert selection.shared_queues(c) == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_prescale_many(spark):
    """Two million rows with a payload: every tenth, whatever else is read."""
    n = 2_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).alias("o"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = selection.prescale(rows, 10, ["g"], ["o"], chunks=40)
    got = out.agg(F.count("*"), F.sum((F.col("o") % 10 == 9).cast("int")), F.countDistinct("payload")).first()
    assert tuple(got) == (n // 10,) * 3


def test_header(spark):
    names = [n for n, _ in assembly.HEADER]
    fields = {n: F.lit(i + 1) for i, n in enumerate(names)} | {"n_paths": F.lit(3), "size": F.lit(assembly.HEADER_BYTES + 1), "event_number": F.lit(2**40)}
    h = one(spark, assembly.parse_event_header(assembly.pack_header(fields, F.unhex(F.lit("27")))))
    assert (h.code, h.event_number, h.output_module_id, h.states, h.header_ok) == (1, 2**40, 7, [3, 1, 2], True)
    short = one(spark, assembly.parse_event_header(F.unhex(F.lit("0102"))))
    assert (short.code, short.version, short.run_number, short.states, short.header_ok) == (1, 2, None, None, False)


def test_prescale(spark):
    rows = spark.createDataFrame([(i % 2, i) for i in range(50)], "g int, o int")
    got = sorted(r.o for r in selection.prescale(rows, 5, ["g"], ["o"]).collect())
    want = sorted(o for g in (0, 1) for k, o in enumerate([i for i in range(50) if i % 2 == g], 1) if k % 5 == 0)
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_adler(spark, chunks):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(chunks)], "k int, i int, c binary")
    assert assembly.adler32_of(df, ["k"], "i", "c").first()["adler32"] == zlib.adler32(b"".join(chunks))


def test_file_checksums(spark, tmp_path):
    for n, d in (("a.dat", b"abc" * 99), ("b.dat", b""), ("c.dat", b"x")):
        (tmp_path / n).write_bytes(d)
    book = spark.createDataFrame([("a.dat", zlib.adler32(b"abc" * 99)), ("b.dat", 5), ("c.dat", 0)], "name string, adler32 long")
    got = {r.name: r.matches for r in logs.file_checksums(spark, str(tmp_path), book).collect()}
    assert got == {"a.dat": True, "b.dat": False, "c.dat": True}


def fragments(spark, rows):
    return spark.createDataFrame([(1, 1, e, 1, 1, 1, i, n, 10, t) for e, i, n, t in rows], "code int, run_number long, event_number long, originator_pid long, originator_guid long, secondary_id long, frame_index int, num_frames int, data_size long, arrival timestamp_ntz")


def test_assembly(spark):
    import datetime as d

    t = d.datetime(2020, 1, 1)
    rows = [(1, 0, 1, t)] + [(2, i, 3, t) for i in (2, 0, 1)] + [(3, i, 5, t) for i in range(4)] + [(4, 0, 2, t), (4, 0, 2, t)] + [(5, 0, 2, t), (5, 1, 3, t)] + [(6, 7, 2, t)]
    got = {r.event_number: (r.complete, r.fault_bits, r.faulty) for r in assembly.assemble(fragments(spark, rows)).collect()}
    assert got[1] == got[2] == (True, 0, False)
    assert got[3] == (False, 0x80, False)
    assert got[4] == (False, 0xC0, True)
    assert got[5][1] & 0x10
    assert got[6][1] & 0x2
    stale = assembly.stale(assembly.assemble(fragments(spark, rows)), F.lit("2020-01-01 00:02:00").cast("timestamp_ntz")).collect()
    assert {r.event_number for r in stale} == {3, 4, 5, 6}
    assert all(r.fault_bits & 0x10000 for r in stale)


def test_quantity(spark):
    m, n = 3.5, 10
    df = spark.createDataFrame([("k", i, i * m) for i in range(1, n + 1)], "k string, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    r = stats.quantity_full(df, ["k"], "ts", "v").first()
    assert r.n == n
    assert r.sum == pytest.approx(n * (n + 1) / 2 * m)
    assert r.avg == pytest.approx((n + 1) / 2 * m)
    assert r.rms == pytest.approx(m * math.sqrt((n * n - 1) / 12))
    assert (r.min, r.max, r.duration, r.sample_rate) == (m, n * m, n, 1.0)
    last = stats.quantity_recent(df, ["k"], "ts", "v", 1, 2).orderBy(F.desc("t")).first()
    assert last.sum == pytest.approx((2 * n - 1) * m)


def test_idle_times(spark):
    rows = [("k", 1, 2.0, 10.0), ("k", 2, 3.0, 10.0), ("k", 3, 25.0, 10.0), ("k", 4, 1.0, 10.0)]
    got = {r.t: r.idle for r in stats.smooth_idle_times(spark.createDataFrame(rows, "k string, t int, idle double, duration double"), ["k"], "t").collect()}
    assert got == {4: 1.0, 3: 10.0, 2: 10.0, 1: 10.0}


def test_idle_times_query(spark, sf):
    """The registered query over the whole table, against a loop from the newest tick back."""
    from collections import defaultdict

    ticks = defaultdict(lambda: defaultdict(float))
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "value").collect():
        ticks[r.user_id % 8][(100000 + r.ts.day) * 100 + 1 + r.ts.hour] += math.floor(r.value * 1000 + 0.5) / 1000
    want = {}
    for broker, idle in ticks.items():
        group = []
        for t in sorted(idle, reverse=True):
            group.append(t)
            if sum(idle[x] for x in group) <= 400.0 * len(group) or t == min(idle):
                want |= {(broker, x): sum(idle[y] for y in group) / len(group) for x in group}
                group = []
    got = {(r.broker_id, r.tick): r.idle for r in registry.queries()["g20_smooth_idle_times"](spark, sf).collect()}
    assert {t % 100 for _, t in got} == set(range(1, 25))
    assert got == pytest.approx(want)


def roll(sizes, most, header):
    out, size, n, f = [], header, 0, 0
    for v in sizes:
        if size + v > most and n:
            f, size, n = f + 1, header, 0
        size, n = size + v, n + 1
        out.append(f)
    return out


@pytest.mark.parametrize("chunks", [1, 6, 37])
def test_file_roll(spark, chunks):
    """Sections of any length over one or many ranges, with sizes of 0, null and beyond the limit, and a null section, against a loop."""
    rnd = random.Random(chunks)
    for most, header in ((100, 0), (7, 3), (10**6, 5), (40, 0)):
        rows, want = [], {}
        for section, n in ((1, 1), (2, 40), (None, 700), (3, 300), (4, 9)):
            sizes = [rnd.choice([0, None, 1, 12, most + 9, rnd.randrange(60)]) for _ in range(n)]
            rows += [("s", 1, section, i, v) for i, v in enumerate(sizes)]
            want |= {(section, i): f for i, f in enumerate(roll([v or 0 for v in sizes], most, header))}
        df = spark.createDataFrame(rows, "stream string, run_number long, lumi_section long, o int, data_size long").repartition(3)
        out = files.assign_files(df, F.lit(most), ["o"], header=header, chunks=chunks)
        assert out.columns == [*df.columns, "file_counter"]
        assert {(r.lumi_section, r.o): r.file_counter for r in out.collect()} == want


def test_file_roll_in_proportion(spark):
    """A million events of one section in many ranges; the counts are those of the plain sum."""
    df = spark.range(1_000_000).selectExpr("'s' AS stream", "1 AS run_number", "1 AS lumi_section", "id AS o", "10 AS data_size")
    out = files.assign_files(df, F.lit(95), ["o"], chunks=16)
    assert tuple(out.agg(F.max("file_counter"), F.sum((F.col("file_counter") != F.expr("o div 9")).cast("int"))).first()) == (111_111, 0)


def test_checksums_of_many_chunks(spark):
    """A key whose chunks lie in many ranges, and a null one."""
    rows = [(k, i, bytes([i % 251]) * (i % 7)) for k in (1, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, i int, c binary").repartition(5)
    want = zlib.adler32(b"".join(c for k, _, c in rows if k == 1))
    assert [r.adler32 for r in assembly.adler32_of(df, ["k"], "i", "c").collect()] == [want, want]


DQM = "run_number int, lumi_section int, top_folder string, folder string, object_name string, kind string, sender int, update_number int, bin int, content long, entries long, arrival int, w long, wy long, wyy long"


def test_merge_order(spark):
    """The first update counts whole though it has no entries, later ones only with entries; bins keep their numbers."""
    row = lambda kind, u, b: (1, 1, "t", "f", "h", kind, 1, u, b, u * 10 + b, u % 2, u, 1, u, u * u)
    rows = [row("TH1", u, b) for u in range(6) for b in (0, 2, 7)]
    a, b = (dqm.merge_histograms(spark.createDataFrame(r, DQM)).first() for r in (rows, rows[::-1]))
    assert a == b
    assert a.bins == {k: sum(u * 10 + k for u in (0, 1, 3, 5)) for k in (0, 2, 7)} and (a.total, a.entries) == (sum(a.bins.values()), 9)
    p = dqm.merge_profiles(spark.createDataFrame([row("TProfile", u, b) for u in range(6) for b in (0, 2)], DQM)).first()
    assert {k: (v.w, v.wy, v.wyy, v.mean) for k, v in p.bins.items()} == {k: (4, 9, 35, 2.25) for k in (0, 2)}
    assert p.bins[0].spread == pytest.approx(math.sqrt(35 / 4 - 2.25**2))
    assert dqm.merge_scalars(spark.createDataFrame([row("int", u, 0) for u in range(6)], DQM)).first().content == 0


def test_merge_null_keys(spark):
    rows = [(1, None, None, "f", None, "TH1", 1, u, None, 5, 1, u, 1, 1, 1) for u in range(3)]
    m = dqm.merge_histograms(spark.createDataFrame(rows, DQM).na.fill({"bin": 0})).first()
    assert (m.top_folder, m.object_name, m.bins, m.entries) == (None, None, {0: 15}, 3)


def test_statuses(spark):
    n, L = F.lit, lambda *x: [F.lit(v) for v in x]  # noqa: E741
    assert one(spark, status.open_status(*L(5, 4, 400))) == 2
    assert one(spark, status.injected_check(*L(0, 800, 0, 1, 100))) == 3
    assert one(spark, status.injected_check(*L(0, 8, 8, 1, 9999))) == 2
    assert one(spark, status.checked_check(*L(3, 3, 1, 0))) == 0
    assert one(spark, status.repacked_check(*L(7, 3, 10, 0, 0))) == 4
    assert one(spark, status.stream_status(n("A_NoRepack"))) == 2
    assert one(spark, stats.busy_percent(n(2), n(1.0), n(4.0))) == 75.0
    assert one(spark, duration_text(n(90061), "HH")) == "01"
    with pytest.raises(ValueError):
        duration_text(n(1), "XX")


def test_texts(spark):
    lines = spark.createDataFrame([("./closeFile.pl  --FILENAME a.dat --N_EVENTS 21",), ("./closeFile.pl --FILENAME a b",), ("junk",)], "value string")
    r = logs.parse_file_log(lines).collect()
    assert r[0].args == {"FILENAME": "a.dat", "NEVENTS": "21"}
    assert [x.rejected for x in r] == [False, True, True]
    page = "<td>Disk 1 has failed</td><td>Disk 2 has failed</td><b>Controller has failed</b>"
    assert one(spark, logs.storage_page_status(F.lit(page))) == 102
    assert one(spark, logs.storage_page_status(F.lit("<td>fine</td>"))) == 0


@pytest.mark.parametrize("policy", ["old", "new"])
def test_buffer(spark, tmp_path, policy):
    rnd = random.Random(3)
    rows = [("c", "poll" if rnd.random() < 0.2 else "event", i, i) for i in range(200)]
    spark.createDataFrame(rows, "consumer string, kind string, seq long, event_number long").coalesce(1).write.parquet(str(tmp_path / "rows.parquet"))
    src = spark.readStream.schema("consumer string, kind string, seq long, event_number long").parquet(str(tmp_path / "rows.parquet"))
    got = sorted((r.poll_id, r.event_number, r.dropped_before) for r in stateful.drain(stateful.consumer_buffer(src, 3, policy), "append").collect())
    queue, dropped, want = [], 0, []
    for _, kind, seq, e in rows:
        if kind == "poll":
            if queue:
                want.append((seq, queue.pop(0), dropped))
                dropped = 0
        elif len(queue) < 3:
            queue.append(e)
        else:
            dropped += 1
            if policy == "old":
                queue = [*queue[1:], e]
    assert got == want


def test_read_table_layouts(spark, tmp_path):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    df.repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    df.toPandas().to_parquet(tmp_path / "single.parquet")
    for name in ("parts", "single"):
        got = stateful.drain(stateful.read_table(spark, str(tmp_path), name), "append").collect()
        assert sorted((r.id, r.v) for r in got) == [(i, 2 * i) for i in range(50)]


def test_pages_not_gathered(spark, sf):
    """Pages are scored a file and summed, not joined to one text a host."""
    plan = registry.queries()["a13_storage_page_status"](spark, sf)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_registry():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 150
