"""The books as a stream: files are entered once, whatever is sent again, and summaries grow by what each micro-batch changes.

What a micro-batch writes is named by its number and follows from the batches before it, so a batch that is run again, after a failure or a restart, writes the
same and nothing counts twice. A file's stages may come in any order and in any batch: a file adds to the summaries what it adds when all that is known of it is joined,
less what it added before.

Under the folder: ``events/batch=n`` (the events that were new), ``deltas/batch=n`` (what these changed, by run, stream and instance) and ``snapshots/n`` (all deltas
up to there, every ``EVERY`` batches), so a summary is one snapshot and at most ``EVERY`` deltas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import books
from ..operators.ordered import join_keys

EVERY = 20
GRAIN = ["runnumber", "stream", "instance"]
STAGES = ["created", *books.STAGES, "deleted"]
#: Columns of an event besides file_key, stage and at (its time): those of the created row, then those of the injected one.
CREATED = {"filename": "string", "hostname": "string", "setuplabel": "string", "stream": "string", "producer": "string", "runnumber": "long", "lumisection": "long", "instance": "long"}
INJECTED = {"nevents": "long", "filesize": "long", "comment_str": "string"}
EVENT = f"file_key long, stage string, at timestamp, {', '.join(f'{n} {t}' for n, t in (CREATED | INJECTED).items())}"


def events_of(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables of the stages as one table of events. tables: stage to its rows, with their time in ctime, itime or dtime."""
    out = []
    for stage, t in tables.items():
        at = F.col("ctime" if stage == "created" else "dtime" if stage == "deleted" else "itime").cast("timestamp").alias("at")
        own = CREATED if stage == "created" else INJECTED if stage == "injected" else {}
        out.append(t.select(F.col("file_key").cast("long").alias("file_key"), F.lit(stage).alias("stage"), at, *((F.col(n) if n in own else F.lit(None)).cast(k).alias(n) for n, k in (CREATED | INJECTED).items())))
    return reduce(DataFrame.unionByName, out)


def first_entries(events: DataFrame) -> DataFrame:
    """Of each file and stage the entry of the earliest batch, of one batch the earliest, ties by their columns: later ones are refused, as a unique key would."""
    rest = [c for c in events.columns if c not in ("file_key", "stage")]
    best = F.min(F.struct("__batch", *(c for c in rest if c != "__batch")))
    return events.where("file_key IS NOT NULL AND stage IS NOT NULL").groupBy("file_key", "stage").agg(best.alias("e")).select("file_key", "stage", "e.*")


def _info() -> list[Column]:
    """Aggregates of a file's entries: the columns of files_info, and whether its created row is known."""
    is_ = lambda s: F.col("stage") == s
    picked = [F.max(F.when(is_("created"), F.col(c))).alias(c) for c in CREATED] + [F.max(F.when(is_("injected"), F.col(c))).alias(c) for c in INJECTED]
    times = [F.max(F.when(is_("created"), F.col("at"))).alias("ctime"), *(F.max(F.when(is_(s), F.col("at"))).alias(f"t_{s}") for s in STAGES[1:])]
    return [F.max(is_("created").cast("int")).alias("__known"), *picked, *times]


def info_of(entries: DataFrame) -> DataFrame:
    """files_info of the files whose created row is known, from one grouped aggregate over their entries."""
    return entries.groupBy("file_key").agg(*_info()).where("__known = 1").drop("__known")


def _columns_of(stage: str) -> list[str]:
    return [*CREATED, "ctime"] if stage == "created" else [*INJECTED, "t_injected"] if stage == "injected" else [f"t_{stage}"]


def changes_of(entries: DataFrame, batch: int) -> DataFrame:
    """Of the files with an entry in the batch, files_info with it (``__sign`` 1) and as it was before (-1), from one aggregate: an entry is a file's only one of
    its stage, so what was before lacks the columns of the stages that are new."""
    bits = {s: 1 << i for i, s in enumerate(STAGES)}
    fresh = F.when(F.col("__batch") == batch, F.coalesce(*(F.when(F.col("stage") == s, b) for s, b in bits.items()), F.lit(0)))
    g = entries.groupBy("file_key").agg(*_info(), F.bit_or(fresh).alias("__fresh")).where("__fresh IS NOT NULL")
    g = g.withColumn("__sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    there = lambda s: (F.col("__sign") > 0) | (F.col("__fresh").bitwiseAND(F.lit(bits[s])) == 0)
    known = g.where((F.col("__known") == 1) & there("created"))
    return known.select("file_key", "__sign", *(F.when(there(s), F.col(c)).alias(c) for s in STAGES for c in _columns_of(s)))


def _added(info: DataFrame, sign: Column) -> DataFrame:
    """What files add at the grain of the deltas; what is taken away has sums only."""
    cols = {n: (kind, c) for n, (kind, c) in books.measures().items()} | {"injected": ("sum", F.when(F.col("t_injected").isNotNull(), 1).otherwise(0).cast("long")), "files": ("sum", F.lit(1).cast("long"))}
    kinds = dict(info.select(*(c.alias(n) for n, (_, c) in cols.items())).dtypes)
    values = [(c * sign if kind == "sum" else F.when(sign > 0, c)).cast(kinds[n]).alias(n) for n, (kind, c) in cols.items()]
    return info.select(*GRAIN, *values)


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    kinds = {n: kind for n, (kind, _) in books.measures().items()} | {"injected": "sum", "files": "sum"}
    return rows.groupBy(*keys).agg(*(books.AGGREGATES[kind](n).alias(n) for n, kind in kinds.items()))


class Books:
    """The books in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        empty = spark.createDataFrame([], EVENT).withColumn("__batch", F.lit(0).cast("long"))
        self.event_schema: StructType = empty.schema
        self.delta_schema: StructType = _merged(_added(info_of(empty), F.lit(1)), GRAIN).schema

    def _read(self, kind: str, schema: StructType, batches: range) -> DataFrame:
        if not len(batches):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/batch={b}" for b in batches))

    def add(self, events: DataFrame, batch: int) -> None:
        """Enters a micro-batch: for ``foreachBatch``. Batches are numbered from 0 without gaps."""
        new = first_entries(events.select(*(c for c in self.event_schema.names if c != "__batch")).withColumn("__batch", F.lit(batch).cast("long")))
        prior = self._read("events", self.event_schema, range(batch))
        fresh = new.join(prior.select("file_key", "stage"), ["file_key", "stage"], "left_anti").select(*self.event_schema.names)
        fresh.write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        entries = self._read("events", self.event_schema, range(batch + 1))
        _merged(_added(changes_of(entries, batch), F.col("__sign")), GRAIN).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        if (batch + 1) % EVERY == 0:
            self._deltas(batch).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{batch}")

    def _deltas(self, batch: int) -> DataFrame:
        """All deltas up to a batch, merged at their grain."""
        last = batch // EVERY * EVERY - 1  # the latest snapshot before it
        rows = self._read("deltas", self.delta_schema, range(last + 1, batch + 1))
        if last >= 0:
            rows = rows.unionByName(self.spark.read.schema(self.delta_schema).parquet(f"{self.folder}/snapshots/{last}"))
        return _merged(rows, GRAIN)

    def summary(self, keys: list[str], batch: int) -> DataFrame:
        """The roll-up after a batch; keys of GRAIN."""
        grain = self._deltas(batch).where("files > 0")
        n = grain.groupBy(*keys).agg(F.countDistinct(F.when(F.col("injected") > 0, F.col("instance"))).alias("n_instance"))
        return join_keys(_merged(grain, keys).drop("injected", "files"), n, keys)

    def files(self, batch: int) -> DataFrame:
        """All entries up to a batch, each once."""
        return self._read("events", self.event_schema, range(batch + 1))


def run(stream: DataFrame, store: Books, checkpoint: str) -> int:
    """Enters all that is there; a run with the same checkpoint goes on behind it. Returns the number of the last batch ever entered, -1 for none."""
    last = [-1]

    def each(df: DataFrame, batch: int) -> None:
        Books(df.sparkSession, store.folder).add(df, batch)
        last[0] = batch

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return last[0]
