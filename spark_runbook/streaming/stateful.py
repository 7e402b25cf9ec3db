"""Streams: tick windows, sessions and keyed state with timers, on micro-batches. Each gives what its batch form gives."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; a local one only where no checkpoint folder is set and all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, sf_dir: str, name: str, files_a_batch: int | None = None, bytes_a_batch: int | None = None) -> DataFrame:
    """A table's Parquet, a file or a folder of part files, as a stream: so many files a micro-batch, or files of so many bytes (one at least), or else one file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    by_bytes = bytes_a_batch and not files_a_batch
    src = spark.readStream.schema(schema).option("maxBytesPerTrigger" if by_bytes else "maxFilesPerTrigger", bytes_a_batch if by_bytes else files_a_batch or 1)
    return src.parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may match a file or a folder; a plain path must be a folder


def drain(stream: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its rows: all appended ones, or the last complete result."""
    spark = stream.sparkSession
    out, ck = shared_folder(spark, "stream"), shared_folder(spark, "state")
    writer = stream.writeStream.option("checkpointLocation", ck).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", out).outputMode("append").start()
    else:
        q = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tick_counts(events: DataFrame, key: str, ts: str, value: str, tick: str) -> DataFrame:
    """Tumbling windows of a tick."""
    return events.groupBy(key, F.window(ts, tick)).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))


def sliding_counts(events: DataFrame, key: str, ts: str, span: str, tick: str) -> DataFrame:
    return events.groupBy(key, F.window(ts, span, tick)).agg(F.count("*").alias("n"))


def idle_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of events without a pause of the gap: what closes a file that lies idle."""
    return events.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


SERVED = "consumer string, poll_id long, event_number long, dropped_before long"


def consumer_buffer(rows: DataFrame, size: int, policy: str = "old") -> DataFrame:
    """Bounded buffers: rows of kind event fill a consumer's buffer, rows of kind poll take its oldest event, with the number dropped since the poll before.
    A full buffer drops its oldest ("old") or refuses the newest ("new"). rows: consumer, kind, seq, event_number."""

    def step(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ("", 0)
        queue = [int(x) for x in held.split(",") if x]
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            if r.kind == "poll":
                if queue:
                    out.append((k[0], int(r.seq), queue.pop(0), dropped))
                    dropped = 0
            elif len(queue) < size:
                queue.append(int(r.event_number))
            else:
                dropped += 1
                if policy == "old":
                    queue.pop(0)
                    queue.append(int(r.event_number))
        state.update((",".join(map(str, queue)), int(dropped)))
        yield pd.DataFrame(out, columns=["consumer", "poll_id", "event_number", "dropped_before"])

    return rows.groupBy("consumer").applyInPandasWithState(step, SERVED, "held string, dropped long", "append", GroupStateTimeout.NoTimeout)


def consumer_expiry(rows: DataFrame, timeout_s: int) -> DataFrame:
    """Batch form of staleness: events that came later than the timeout after the consumer's last poll (or its earliest row) are refused. Polls are carried over ranges of a consumer's rows."""
    from ..operators.ordered import join_keys, scan

    out = scan(rows, ["consumer"], ["seq"], __p=("max", F.when(F.col("kind") == "poll", F.col("t")), True))
    first = rows.groupBy("consumer").agg(F.min("t").alias("__f"))
    return join_keys(out, first, ["consumer"]).withColumn("stale", F.col("t") - F.coalesce("__p", "__f") > timeout_s).drop("__p", "__f")
