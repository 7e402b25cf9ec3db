"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and all runs in one process (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the session's checkpoint folder and reads it again: its lineage is cut, a lost executor costs nothing but reruns, and
    plans see its true size (a checkpoint keeps the estimates of the plan before it, which multiply from join to join). The shuffle files of the step
    go as soon as it is written; else all steps' files would stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    was = spark.conf.get(SHUFFLES_GO)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, was)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Limits what Spark sends to Python at a time to ``BATCH_BYTES`` (or one row), where the session allows more: buffers on both sides follow the bytes of a batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8_bytes(name: str = "text") -> Column:
    """Length of the text in UTF-8 bytes, null: 0."""
    return F.octet_length(text_or_empty(name)).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Texts without other letters take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front of it if df has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def renamed(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with its columns named by place, the new names of ``cols``, and what gives a result its old columns back: so that no column an
    operator adds can meet one of the input's."""
    new = [f"c{i}" for i in range(len(df.columns))]
    at = {c.lower(): n for c, n in zip(df.columns, new, strict=True)}
    return df.toDF(*new), [at[c.lower()] for c in cols], lambda out: out.select(*(F.col(n).alias(c) for n, c in zip(new, df.columns, strict=True)))


SALTS, HEAVY = 64, 500


def heavy_keys(groups: DataFrame, key: str, count: str) -> list:
    """Keys with more than a ``HEAVY``-th of all rows; so there are at most ``HEAVY``. groups: a row a key, with its number of rows."""
    total = groups.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in groups.where(F.col(count) > max(200, total // HEAVY)).select(key).collect()]


def spread_join(rows: DataFrame, groups: DataFrame, key: str, heavy: list, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined to groups (a row a key) by key. The keys in ``heavy`` are dealt over ``SALTS`` tasks: their rows by ``spread``, their row of groups once for each."""
    if not heavy:
        return rows.join(groups, key, how)
    split = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    none, last = F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")
    left = rows.withColumn("__salt", F.when(split, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(none))
    right = groups.withColumn("__salt", F.explode(F.when(split, F.sequence(none, last)).otherwise(F.array(none))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


class Shared:
    """A numpy array for all tasks, broadcast compressed (a filter of few bits is small on disk and wire) and opened once a task."""

    _open: dict[str, np.ndarray] = {}

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.key, self.kind = uuid.uuid4().hex, array.dtype.str
        self.data = spark.sparkContext.broadcast(zlib.compress(array.tobytes(), 1))

    @property
    def value(self) -> np.ndarray:
        known = Shared._open
        if self.key not in known:
            while len(known) > 1:
                known.pop(next(iter(known)))
            known[self.key] = np.frombuffer(zlib.decompress(self.data.value), self.kind)
        return known[self.key]


class Kept:
    """What a worker keeps from task to task: for an operator's name, a dictionary of its compiled models."""

    of: dict[str, dict] = {}


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; nothing depends on it


def give_back(f, keeps: str | None = None):
    """A function over batches whose worker closes shared arrays and returns freed memory to the system when the task ends: workers live on, and
    what one stage has held would otherwise count against the next. For the same reason a task first drops what other operators than ``keeps`` have in ``Kept``."""

    @functools.wraps(f)
    def run(batches, *args):
        others = [d for name, d in Kept.of.items() if name != keeps and d]
        for d in others:
            d.clear()
        if others:
            _trim()
        try:
            yield from f(batches, *args)
        finally:
            Shared._open.clear()
            _trim()

    return run
