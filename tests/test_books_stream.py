"""Incremental books: any split into batches, batches run again, restarts after a failure, snapshots, and odd rows."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from spark_runbook.operators import books
from spark_runbook.streaming import books_stream as bs
from spark_runbook.streaming import stateful as ss

DAY = datetime(2024, 1, 1)


def event(key, stage, day, **cols):
    at = DAY + timedelta(days=day)
    return (key, stage, at, *(cols.get(c) for c in (*bs.CREATED, *bs.INJECTED)))


@pytest.fixture(scope="module")
def rows():
    out = []
    for k in range(40):
        own = {"filename": f"f{k}", "hostname": f"h{k % 3}", "setuplabel": "Data", "stream": ["A", "Error", "X_NoRepack", None][k % 4], "producer": "Logger" if k % 5 else "Other", "runnumber": None if k % 7 == 0 else 1 + k % 2, "lumisection": k % 6, "instance": k % 3}
        out.append(event(k, "created", k % 9, **own))
        for i, stage in enumerate(bs.STAGES[1 : 1 + k % 8]):
            out.append(event(k, stage, 10 + i, **({"nevents": k, "filesize": 100 + k, "comment_str": f"c{k % 4}"} if stage == "injected" else {})))
    return [*out, event(99, "injected", 3, nevents=7, filesize=7), event(None, "created", 1, runnumber=1, stream="A")]  # a file that is never created, and one without a key


def whole(spark, rows, keys):
    e = spark.createDataFrame(rows, bs.EVENT).withColumn("__batch", F.lit(0).cast("long"))
    return plain(books.summary(bs.info_of(bs.first_entries(e)), keys))


def plain(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split(spark, tmp_path, rows, seed, monkeypatch):
    """Batches of any size, in any order, with rows sent again and one batch run twice."""
    monkeypatch.setattr(bs, "EVERY", 3)
    rnd = random.Random(seed)
    sent = [*rows, *rnd.sample(rows, 15)]
    rnd.shuffle(sent)
    cuts = sorted(rnd.sample(range(1, len(sent)), 5))
    store = bs.Books(spark, f"file://{tmp_path}/books")
    for b, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(sent)], strict=True)):
        part = spark.createDataFrame(sent[a:z], bs.EVENT)
        store.add(part, b)
        if b in (1, 2):
            store.add(part.repartition(3), b)
    for keys in (["runnumber", "stream"], ["runnumber", "instance"]):
        assert plain(store.summary(keys, 5)) == whole(spark, rows, keys)
    assert store.files(5).count() == len(rows) - 1


def test_restart_after_a_failure(spark, tmp_path, rows, monkeypatch):
    """The stream dies between the two writes of a batch; the next run does that batch again and books each file once."""
    (tmp_path / "in.parquet").mkdir()
    for i in range(4):
        pq.write_table(spark.createDataFrame(rows[i::4], bs.EVENT).toArrow(), name := tmp_path / "in.parquet" / f"p{i}.parquet")
        os.utime(name, (1_700_000_000 + i,) * 2)
    schema = spark.createDataFrame([], bs.EVENT).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in.parquet"))
    store, state = bs.Books(spark, f"file://{tmp_path}/books"), str(tmp_path / "state")
    merged = bs._merged
    monkeypatch.setattr(bs, "_merged", lambda df, keys: (_ for _ in ()).throw(RuntimeError("killed")) if os.path.exists(tmp_path / "books/events/batch=2") else merged(df, keys))
    with pytest.raises(Exception, match="killed"):
        bs.run(stream(), store, state)
    assert os.path.exists(tmp_path / "books/events/batch=2") and not os.path.exists(tmp_path / "books/deltas/batch=2")
    monkeypatch.setattr(bs, "_merged", merged)
    last = bs.run(stream(), bs.Books(spark, store.folder), state)
    assert last == 3 and plain(store.summary(["runnumber", "stream"], last)) == whole(spark, rows, ["runnumber", "stream"])
    assert store.files(last).groupBy("file_key", "stage").count().where("count > 1").isEmpty()


def test_second_insert_is_refused(spark, tmp_path):
    store = bs.Books(spark, f"file://{tmp_path}/books")
    for b, host in enumerate(("first", "second")):
        store.add(spark.createDataFrame([event(1, "created", 5 - b, hostname=host, runnumber=1, stream="A", producer="Logger")], bs.EVENT), b)
    assert [r.hostname for r in store.files(1).collect()] == ["first"]
    assert [(r.s_created, r.hostname) for r in store.summary(["runnumber", "stream"], 1).collect()] == [(1, "first")]


def test_no_events(spark, tmp_path):
    store = bs.Books(spark, f"file://{tmp_path}/books")
    store.add(spark.createDataFrame([], bs.EVENT), 0)
    assert store.summary(["runnumber", "stream"], 0).count() == 0 and store.files(0).count() == 0
    assert ss.shared_folder(spark, "x") != ss.shared_folder(spark, "x")


def test_changes_of_one_batch(spark, rows):
    """what a batch changes comes from one aggregate, equal to files_info with the batch less files_info without it."""
    e = spark.createDataFrame(rows, bs.EVENT).where("file_key IS NOT NULL").withColumn("__batch", F.pmod(F.xxhash64("stage", "file_key"), F.lit(3)))
    got = bs.changes_of(e, 2)
    fresh = e.where("__batch = 2").select("file_key").distinct()
    for sign, known in ((1, e), (-1, e.where("__batch < 2"))):
        want = bs.info_of(known).join(fresh, "file_key", "left_semi")
        assert plain(got.where(F.col("__sign") == sign).drop("__sign")) == plain(want)
