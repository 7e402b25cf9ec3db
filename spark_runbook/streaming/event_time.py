"""Streams whose result doesn't depend on how a table is cut into files, or in which order these are read.

Rows wait until the watermark has passed their time, and are then taken in the order of time: a watermark's delay (``disorder``) is the bound within which rows may
come late. At the end of a run all that waits is put out: the drain at the end of a run.

Each micro-batch (``foreachBatch``) writes its rows to a table of its own, takes the rows that the watermark has passed by then, from the micro-batches that have such rows, and writes what they give
and what stays open. Tables are named by the micro-batch's number and follow from those of earlier ones, so a micro-batch that is run again writes the same. A row is written and read
once or a few times, whatever the number of micro-batches, and no row goes through a keyed store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ordered import join_keys
from .stateful import shared_folder

AT = "__at"
#: The watermark at the end of a run (the year 2262); before the first row it is NEVER.
RUN_ENDED_MS, NEVER = 9_214_646_400_000, -(1 << 62)
#: Micro-batches that have rows waiting, with their first and last time; the watermark; the micro-batch that last took rows.
_MARKS = "batch long, low long, high long, watermark long, taken long"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """Keyed state with timers needs this store; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Step:
    """What a stream's rows go through. ``rows``: the stream, its time in ms in ``__at``; ``schema``: of what is put out."""

    rows: DataFrame
    schema: StructType

    def combined(self, new: DataFrame) -> DataFrame:
        """What waits for the rows of a micro-batch: they may be combined as they come."""
        return new

    def take(self, due: DataFrame, state: Callable[[str, StructType], DataFrame], keep: Callable[[str, DataFrame], DataFrame], now: int) -> DataFrame:
        """What is put out as the watermark comes to ``now``, from the rows that it has passed. ``state`` reads what an earlier call has kept by name, ``keep`` writes and returns it."""
        raise NotImplementedError


def _timed(stream: DataFrame, time: str, *cols: str) -> DataFrame:
    return stream.select(*cols, F.unix_millis(F.col(time)).alias(AT))


def ended(main: DataFrame, time: str, disorder: str, build: Callable[[DataFrame], Step], each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Runs the step that build makes of the stream ``main`` over all that is there, with a watermark on ``time``, and ends the run; returns the rows put out, or hands
    them to ``each`` with the micro-batch's number. Rows without a time, which no watermark passes, and rows behind the watermark are dropped."""
    spark, step = main.sparkSession, build(main)
    folder, out = shared_folder(spark, "waiting"), shared_folder(spark, "stream")
    delay = spark.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {disorder}"))).first()[0]
    kept: dict[str, StructType] = {}
    last = [-1]

    def release(s: SparkSession, n: int, spans: list[tuple], before: int, now: int, taken: int) -> None:
        """Takes what the watermark has passed and notes what still waits."""
        due = [b for b, low, _ in spans if low <= now]
        if now > before and (due or taken >= 0 or now == RUN_ENDED_MS):
            at = F.col(AT)
            waits = s.read.schema(kept["rows"]).parquet(*(f"{folder}/rows/{b}" for b in due)) if due else s.createDataFrame([], kept["rows"])
            state = lambda name, schema: s.read.schema(schema).parquet(f"{folder}/{name}/{taken}") if taken >= 0 else s.createDataFrame([], schema)

            def keep(name: str, df: DataFrame) -> DataFrame:
                df.write.mode("overwrite").parquet(f"{folder}/{name}/{n}")
                return s.read.schema(df.schema).parquet(f"{folder}/{name}/{n}")

            made = step.take(waits.where((at > before) & (at <= now)), state, keep, now)
            each(made, n) if each else made.write.mode("overwrite").parquet(f"{out}/batch={n}")
            taken = n
        marks = [(b, low, high, now, taken) for b, low, high in spans if high > now] or [(None, None, None, now, taken)]
        s.createDataFrame(marks, _MARKS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/{n}")

    def marks(s: SparkSession, n: int) -> tuple[list[tuple], int, int]:
        rows = s.read.schema(_MARKS).parquet(f"{folder}/marks/{n}").collect() if n >= 0 else []
        return [(r.batch, r.low, r.high) for r in rows if r.batch is not None], *((rows[0].watermark, rows[0].taken) if rows else (NEVER, -1))

    def micro_batch(df: DataFrame, n: int) -> None:
        s = df.sparkSession
        spans, before, taken = marks(s, n - 1)
        waits = step.combined(df.where(F.col(AT) > before))
        kept["rows"] = waits.schema
        waits.write.mode("overwrite").parquet(f"{folder}/rows/{n}")
        low, high = s.read.schema(waits.schema).parquet(f"{folder}/rows/{n}").agg(F.min(AT), F.max(AT)).first()
        if low is not None:
            spans.append((n, low, high))
        release(s, n, spans, before, max(before, high - delay) if low is not None else before, taken)
        last[0] = n

    step.rows.writeStream.option("checkpointLocation", shared_folder(spark, "state")).trigger(availableNow=True).foreachBatch(micro_batch).start().awaitTermination()
    if last[0] >= 0:
        spans, before, taken = marks(spark, last[0])
        release(spark, last[0] + 1, spans, before, RUN_ENDED_MS, taken)
    if each:
        return None
    if last[0] < 0:
        return spark.createDataFrame([], step.schema)
    return spark.read.schema(step.schema).parquet(f"{out}/batch=*").select(*step.schema.names)


class Fold:
    """What an ordered fold does: ``step`` takes the state (None at first) and a row of ``columns`` at a time in ms, and gives the new state and rows to put out; ``idle`` gives
    the rows of a state for which nothing came for ``timeout_ms``. A state is anything that JSON holds. With ``counted``, rows of a key and time are one row with their number."""

    columns: list[str] = []
    counted = False
    output = ""
    timeout_ms = 0

    def output_names(self) -> list[str]:
        return [field.split()[0] for field in self.output.split(", ")]

    def step(self, state, at: int, row: tuple) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def idle(self, state) -> list[tuple]:
        raise NotImplementedError

    def ended(self, state) -> list[tuple]:
        """Instead of ``idle`` where the run has ended before the timeout."""
        return self.idle(state)


COUNT, STATE = "__n", "__state"


def counted(rows: DataFrame, key: list[str], number: Column) -> DataFrame:
    return rows.groupBy(*key, AT).agg(number.cast("long").alias(COUNT))


def _folded(batches: Iterator[pa.RecordBatch], fold: Fold, n_keys: int, now: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The fold over rows that lie in order of key and time, an open state in front of its key's rows: only one key's state is held at a time."""
    key, state, last = None, None, 0
    out: list[tuple] = []
    blank = (None,) * len(fold.output_names())

    def close() -> None:
        nonlocal state
        if state is not None and last + fold.timeout_ms <= now:
            out.extend((*key, *row, None, None) for row in (fold.ended(state) if now >= RUN_ENDED_MS else fold.idle(state)))
        elif state is not None:
            out.append((*key, *blank, last, json.dumps(state)))
        state = None

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        out.clear()
        return made

    for b in batches:
        columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(c.type) and not c.null_count else c.to_pylist() for c in b.columns]
        for row in zip(*columns, strict=True):
            k, at, held, values = row[:n_keys], row[n_keys], row[n_keys + 1], row[n_keys + 2 :]
            if k != key:
                close()
                key = k
            if held is not None:
                state, last = json.loads(held), at
                continue
            if state is not None and at - last >= fold.timeout_ms:
                out.extend((*k, *r, None, None) for r in fold.idle(state))
                state = None
            state, made = fold.step(state, at, values)
            if made:
                out.extend((*k, *r, None, None) for r in made)
            last = at
        if len(out) > 10_000:
            yield batch()
    close()
    if out:
        yield batch()


class Ordered(Step):
    """The fold over each key's rows in order of time (ties: by the fold's columns), with its key in front of what it puts out. Rows are dealt by key and sorted, and an open state is a row."""

    def __init__(self, stream: DataFrame, key: list[str], time: str, fold: Fold):
        self.key, self.fold = key, fold
        self.rows = _timed(stream, time, *key, *(c for c in fold.columns if c not in key))
        kinds = dict(self.rows.dtypes)
        named = [f"`{k}` {kinds[k]}" for k in key]
        self.schema = StructType.fromDDL(", ".join([*named, fold.output]))
        self.all = StructType.fromDDL(", ".join([*named, fold.output, f"{AT} long", f"{STATE} string"]))

    def combined(self, new):
        return counted(new, self.key, F.count("*")) if self.fold.counted else new

    def take(self, due, state, keep, now):
        return self.folded(due, state, keep, now).where(F.col(STATE).isNull()).select(*self.schema.names)

    def folded(self, due, state, keep, now) -> DataFrame:
        """What is put out, and the states that stay open in ``__at`` and ``__state``."""
        from pyspark.sql.pandas.types import to_arrow_schema

        values = [COUNT] if self.fold.counted else self.fold.columns
        names = [F.col(c).alias(f"__v{i}") for i, c in enumerate(values)]
        held = state("fold", self.all).where(F.col(STATE).isNotNull()).select(*self.key, AT, STATE, *(F.lit(None).cast(dict(due.dtypes)[c]).alias(f"__v{i}") for i, c in enumerate(values)))
        rows = due.select(*self.key, AT, F.lit(None).cast("string").alias(STATE), *names).unionByName(held)
        rows = rows.repartition(*self.key).sortWithinPartitions(*self.key, F.col(STATE).isNull(), AT, *(f"__v{i}" for i in range(len(values))))
        fold, n, arrow = self.fold, len(self.key), to_arrow_schema(self.all)
        return keep("fold", rows.mapInArrow(lambda batches: _folded(batches, fold, n, now, arrow), self.all))


def ordered_fold(stream: DataFrame, key: list[str], time: str, fold: Fold) -> Step:
    return Ordered(stream, key, time, fold)


class Assembly(Fold):
    """Events from fragments: put out when complete, or, with the forced bit, when no fragment came for the timeout. Fragments behind a complete event begin a new one; a chain with a
    fault stays open till it is forced out."""

    columns = ["frame_index", "num_frames", "data_size"]
    output = "n_fragments long, event_size long, complete boolean, fault_bits int"

    def __init__(self, timeout_ms: int = 60_000):
        self.timeout_ms = timeout_ms

    def step(self, state, at, row):
        index, frames, size = row
        seen, total, bytes_, bits = state or [[], frames, 0, 0]
        bits |= (0x10 if frames != total else 0) | (0x40 if index in seen else 0)
        seen, bytes_ = [*seen, index], bytes_ + (size or 0)
        if len(seen) == total and not bits:
            return None, [(len(seen), bytes_, True, 0)]
        return [seen, total, bytes_, bits], []

    def idle(self, state):
        seen, _, bytes_, bits = state
        return [(len(seen), bytes_, False, bits | 0x80 | 0x10000)]


class Ready(Fold):
    """A folder as soon as it has the expected number of updates, or with what it has when none came for the ready time. Updates behind the expected number are part of the folder
    that is out already."""

    counted = True
    output = "n long, reason string"

    def __init__(self, expected: int, ready_ms: int = 120_000):
        self.expected, self.timeout_ms = expected, ready_ms

    def step(self, state, at, row):
        before = state or 0
        n = before + row[0]
        return n, [(self.expected, "complete")] if before < self.expected <= n else []

    def idle(self, state):
        return [(state, "timeout")] if state < self.expected else []


class _Folders(Fold):
    """Spans of time of a folder that is put out: ``began`` to ``last``; of the updates at the time ``last``, all or, where the folder is complete, the first ``part``."""

    counted = True
    output = "began long, last long, part long, n long, reason string"

    def __init__(self, expected: int, ready_ms: int, purge: bool):
        self.expected, self.timeout_ms, self.purge = expected, ready_ms, purge

    def step(self, state, at, row):
        began, _, before = state or (at, at, 0)
        n = before + row[0]
        return [began, at, n], [(began, at, self.expected - before, self.expected, "complete")] if before < self.expected <= n else []

    def _out(self, state, reason):
        began, last, n = state
        return [(began, last, None, n, reason)] if n < self.expected else []

    def idle(self, state):
        return self._out(state, "timeout")

    def ended(self, state):
        return self._out(state, "discarded" if self.purge else "run ended")


UPDATE, OBJECT, SUMS = ["update_number", "sender"], ["folder", "object_name", "kind"], ["content", "entries", "w", "wy", "wyy"]


class Collate(Step):
    """Histograms and profiles of a folder, merged: the first update of an object as it is, later ones only with entries, added by bin (profiles: w, wy and wyy). A folder is
    put out with the expected number of updates, or with what it has when none came for the ready time; what comes behind the expected number is dropped with the folder. With ``purge``, folders that
    aren't ready when the run ends are discarded. What stays open is the folder's merged objects, whatever the number of updates.

    An update is the rows of one time, update_number and sender. Puts out a row an object and bin, with reason and n, the number of updates (a discarded folder: one row without an object).

    Only the numbers of updates by folder and time are folded in order; they say which updates are a folder's. Sums don't depend on the order, so updates are dealt over all tasks, one by one."""

    columns = [*UPDATE, *OBJECT, "bin", *SUMS]

    def __init__(self, stream: DataFrame, key: list[str], time: str, expected: int, ready_ms: int = 120_000, purge: bool = False):
        self.key = key
        self.rows = _timed(stream, time, *key, *self.columns)
        kinds = dict(self.rows.dtypes)
        self.folders = Ordered(stream.withColumn(COUNT, F.lit(1).cast("long")), key, time, _Folders(expected, ready_ms, purge))
        named = [f"`{k}` {kinds[k]}" for k in key]
        merged = [*(f"`{c}` {kinds[c]}" for c in (*OBJECT, "bin")), *(f"{c} long" for c in SUMS)]
        self.schema = StructType.fromDDL(", ".join([*named, "n long, reason string", *merged]))
        self.open = StructType.fromDDL(", ".join([*named, "began long", *merged]))

    def take(self, due, state, keep, now):
        key, time = self.key, [AT, *UPDATE]
        updates = due.select(*key, *time).distinct()
        folds = self.folders.folded(counted(updates, key, F.count("*")), state, keep, now)
        held = F.from_json(STATE, "array<long>")
        still = folds.where(F.col(STATE).isNotNull()).select(*key, held[0].alias("began"), F.col(AT).alias("last"), held[2].alias("n"))
        still = still.where(F.col("n") < self.folders.fold.expected).select(*key, "began", "last", F.lit(None).cast("long").alias("part"), "n", F.lit(None).cast("string").alias("reason"))
        folders = folds.where(F.col(STATE).isNull()).select(*key, "began", "last", "part", "n", "reason").unionByName(still)

        spans = folders.where("reason IS NULL OR reason <> 'discarded'").select(*key, "began", "last", "part")
        inside = join_keys(due, spans, key).where(F.col(AT).between(F.col("began"), F.col("last")))
        edge = F.col("part").isNotNull() & (F.col(AT) == F.col("last"))
        nth = F.dense_rank().over(Window.partitionBy(*key, AT).orderBy(*UPDATE))
        mine = inside.where(~edge).unionByName(inside.where(edge).withColumn("__k", nth).where(F.col("__k") <= F.col("part")).drop("__k"))
        mine = mine.where(F.col("kind").isin("TH1", "TProfile")).drop("last", "part")

        old, one = state("objects", self.open), [*key, "began", *OBJECT]
        of_update = F.sum(F.coalesce("entries", F.lit(0))).over(Window.partitionBy(*one, *time))
        filled = mine.withColumn("__of", of_update).where("__of > 0").drop("__of")
        start = join_keys(mine.groupBy(*one).agg(F.min(AT).alias("__first")), old.select(*one).distinct().withColumn("__old", F.lit(1)), one, "left").where("__old IS NULL").drop("__old")
        first = join_keys(mine, start, one).where(F.col(AT) == F.col("__first")).drop("__first")
        first = first.withColumn("__k", F.dense_rank().over(Window.partitionBy(*one).orderBy(*UPDATE))).where("__k = 1").drop("__k")
        first = first.withColumn("__of", of_update).where("__of <= 0").drop("__of")
        cols = [*one, "bin", *SUMS]
        parts = [filled.select(cols), first.select(cols), old.select(cols)]
        sums = reduce(DataFrame.unionByName, parts).groupBy(*one, "bin").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS))
        known = join_keys(sums, folders.select(*key, "began", "n", "reason"), [*key, "began"])
        known = keep("merged", known)
        keep("objects", known.where("reason IS NULL").select(*self.open.names))
        gone = folders.where("reason = 'discarded'").select(*key, "n", "reason", *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema[len(key) + 2 :]))
        return known.where("reason <> 'discarded'").select(*self.schema.names).unionByName(gone)


class CloseOnLumiEnd(Step):
    """Sections of streams, closed by the end row of their run and section. stream: run_number, lumi_section, stream, kind (event or eols), data_size and ``time``; an
    end row names no stream and closes all of ``streams``, when the watermark has passed it: an end that comes before other files waits for them. Events are counted as they come, so
    what waits is sums of sections."""

    def __init__(self, stream: DataFrame, streams: list[str], time: str):
        self.streams, self.key = streams, ["run_number", "lumi_section", "stream"]
        self.rows = _timed(stream, time, *self.key, "kind", "data_size")
        kinds = dict(self.rows.dtypes)
        named = ", ".join(f"{k} {kinds[k]}" for k in self.key)
        self.open = StructType.fromDDL(f"{named}, n_events long, bytes long, ended boolean")
        self.schema = StructType.fromDDL(f"{named}, n_events long, bytes long, reason string")

    def combined(self, new):
        end = F.col("kind") == "eols"
        to = F.when(end, F.array(*(F.lit(s) for s in self.streams))).otherwise(F.array("stream"))
        sections = new.groupBy(*self.key, end.alias("ended")).agg(F.min(AT).alias("__low"), F.max(AT).alias("__high"), F.count("*").alias("n_events"), F.coalesce(F.sum("data_size"), F.lit(0)).cast("long").alias("bytes"), F.first("kind").alias("kind"))
        at = F.when(F.col("ended"), F.col("__high")).otherwise(F.col("__low")).alias(AT)
        none = lambda c: F.when(F.col("ended"), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
        return sections.select("run_number", "lumi_section", F.explode(to).alias("stream"), at, none("n_events"), none("bytes"), "ended")

    def take(self, due, state, keep, now):
        all_ = state("sections", self.open).unionByName(due.select(*self.open.names))
        sums = all_.groupBy(*self.key).agg(F.sum("n_events").alias("n_events"), F.sum("bytes").alias("bytes"), F.max("ended").alias("ended"))
        kept = keep("sums", sums)
        keep("sections", kept.where("NOT ended").select(*self.open.names))
        return kept.where("ended AND n_events > 0").select(*self.key, "n_events", "bytes", F.lit("LS ended").alias("reason"))


class DropOldLumis(Step):
    """Updates less those that lie more than ``late`` sections behind the largest of their run so far, in order of time. What the watermark has passed is scanned over ranges
    (``operators.ordered``), so a run of any number of updates is dealt over tasks; what is kept is one number a run."""

    def __init__(self, stream: DataFrame, late: int, time: str, order: list[str], by: str = "run_number"):
        self.late, self.order, self.by, self.schema = late, order, by, stream.schema
        self.rows = _timed(stream, time, *stream.columns)
        self.tops = StructType.fromDDL(f"`{by}` {dict(stream.dtypes)[by]}, __top {dict(stream.dtypes)['lumi_section']}")

    def take(self, due, state, keep, now):
        from ..operators.ordered import scan

        known = state("tops", self.tops)
        seen = join_keys(scan(due.drop(AT), [self.by], self.order, __m=("max", F.col("lumi_section"), True)), known, [self.by], "left")
        new = known.unionByName(due.select(self.by, F.col("lumi_section").alias("__top"))).groupBy(self.by).agg(F.max("__top").alias("__top"))
        keep("tops", new)
        return seen.where(F.coalesce(F.col("lumi_section") + self.late >= F.greatest("__m", "__top"), F.lit(True))).select(*self.schema.names)
