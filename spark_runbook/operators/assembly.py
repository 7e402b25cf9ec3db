"""Assembly of events from message fragments, fault bits and checksums."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .ordered import scan

#: Fault bits.
FAULTS = {"invalid_reference": 0x1, "corrupt_header": 0x2, "wrong_total": 0x10, "out_of_order": 0x20, "duplicate": 0x40, "incomplete": 0x80, "checksum": 0x100, "forced": 0x10000}
KEY = ["code", "run_number", "event_number", "originator_pid", "originator_guid", "secondary_id"]


def assemble(fragments: DataFrame, key: list[str] = KEY, order: str = "arrival") -> DataFrame:
    """A row for each key: counts, size, first and last arrival, fault bits, complete and faulty. One grouped aggregate after a map-side
    one over (key, index); the fragments' total is that of the first to arrive."""
    per = fragments.groupBy(*key, "frame_index").agg(
        F.count("*").alias("m"), F.sum("data_size").alias("bytes"), F.min(order).alias("first"), F.max(order).alias("last"),
        F.min(F.struct(order, "num_frames")).alias("told"), F.min("num_frames").alias("lo"), F.max("num_frames").alias("hi"),
        F.max(((F.col("num_frames") < 1) | (F.col("frame_index") >= F.col("num_frames"))).cast("int")).alias("corrupt"),
    )
    g = per.groupBy(*key).agg(
        F.sum("m").alias("n_fragments"), F.count("*").alias("n_indexes"), F.min("told").alias("told"), F.sum("bytes").alias("event_size"), F.min("first").alias("creation_time"),
        F.max("last").alias("last_fragment_time"), (F.min("lo") != F.max("hi")).alias("mixed"), (F.max("m") > 1).alias("twice"), F.max("corrupt").alias("corrupt"),
    )
    bit = lambda c, name: F.when(c, F.lit(FAULTS[name])).otherwise(F.lit(0))
    g = g.withColumn("expected", F.col("told.num_frames").cast("long"))
    bits = bit(F.col("mixed"), "wrong_total") + bit(F.col("twice"), "duplicate") + bit(F.col("corrupt") > 0, "corrupt_header")
    g = g.withColumn("__b", bits).withColumn("complete", (F.col("n_fragments") == F.col("expected")) & (F.col("__b") == 0))
    g = g.withColumn("fault_bits", F.col("__b") + bit(~F.col("complete"), "incomplete"))
    return g.withColumn("faulty", is_faulty(F.col("complete"), F.col("fault_bits"))).drop("told", "mixed", "twice", "corrupt", "__b")


def is_faulty(complete: Column, bits: Column) -> Column:
    """Complete events by any bit; others by any bit but that of being incomplete."""
    return F.when(complete, bits != 0).otherwise(bits != FAULTS["incomplete"])


def header_ok(bits: Column) -> Column:
    """No fault, or that of the checksum alone."""
    return bits.bitwiseAND(F.lit(~FAULTS["checksum"])) == 0


def stale(events: DataFrame, now: Column, timeout_s: int = 60) -> DataFrame:
    """Incomplete events without a fragment for the timeout, marked as forced out; 0 flushes all."""
    from ..functions.times import secs

    old = secs(now) - secs("last_fragment_time") >= timeout_s
    out = events.where(~F.col("complete") & (F.lit(timeout_s == 0) | old))
    return out.withColumn("fault_bits", F.col("fault_bits").bitwiseOR(F.lit(FAULTS["forced"]))).withColumn("faulty", F.lit(True))


@F.pandas_udf(LongType())
def adler32(data):
    """Adler-32 of each value; null: that of nothing."""
    import pandas as pd

    return pd.Series([zlib.adler32(b or b"") for b in data], dtype="int64")


MOD = 65521


def adler32_of(chunks: DataFrame, key: list[str], order: str | list[str], data: str) -> DataFrame:
    """Checksum of each key's chunks joined in order, from the chunks' own: no bytes are shuffled, and no key's chunks are gathered.

    Chunks (a, b, n) form an ordered monoid: behind one that ends with A, a chunk adds a - 1 to A and b + n (A - 1) to B. So A is 1 plus all a - 1, B needs of each
    chunk the running sum of a - 1 before it, which is taken over ranges (``ordered``), and both are plain grouped sums."""
    order = [order] if isinstance(order, str) else order
    low = lambda c: c.bitwiseAND(F.lit(0xFFFF)) - 1
    one = chunks.select(*key, *(o for o in order if o not in key), adler32(F.col(data)).alias("__s"), F.coalesce(F.octet_length(data), F.lit(0)).cast("long").alias("__n"))
    before = scan(one, key, order, __a=("sum", low(F.col("__s")), False))
    b = F.pmod(F.shiftright("__s", 16) + F.pmod("__n", F.lit(MOD)) * F.pmod(F.coalesce("__a", F.lit(0)), F.lit(MOD)), F.lit(MOD))
    sums = before.groupBy(*key).agg(F.pmod(1 + F.sum(low(F.col("__s"))), F.lit(MOD)).alias("a"), F.pmod(F.sum(b), F.lit(MOD)).alias("b"))
    return sums.select(*key, (F.col("b") * 65536 + F.col("a")).alias("adler32"))


#: Fields of a packed event header, big-endian: name and bytes. Behind them stand the trigger bits, two a path, and the data.
HEADER = [("code", 1), ("version", 1), ("size", 4), ("run_number", 4), ("event_number", 8), ("lumi_section", 4), ("output_module_id", 4), ("n_paths", 2)]
HEADER_BYTES = sum(n for _, n in HEADER)


def pack_header(fields: dict[str, Column], bits: Column) -> Column:
    """The bytes of a header and its trigger bits."""
    return F.unhex(F.concat(*(F.lpad(F.hex(fields[name].cast("long")), 2 * n, "0") for name, n in HEADER), F.hex(bits)))


def parse_event_header(payload: Column) -> Column:
    """Struct of a packed header's fields, states (of its paths) and header_ok: long enough, and as long as it says. Fields behind the end are null."""
    from .selection import decode_trigger_bits

    at, out = 1, []
    for name, n in HEADER:
        out.append(F.when(F.octet_length(payload) >= at + n - 1, F.conv(F.hex(F.substring(payload, at, n)), 16, 10).cast("long")).alias(name))
        at += n
    paths = F.conv(F.hex(F.substring(payload, HEADER_BYTES - 1, 2)), 16, 10).cast("int")
    whole = F.octet_length(payload) >= HEADER_BYTES + F.ceil(paths / 4.0)
    size = F.conv(F.hex(F.substring(payload, 3, 4)), 16, 10).cast("long")
    states = F.when(whole, decode_trigger_bits(F.substring(payload, HEADER_BYTES + 1, 1 << 20), paths))
    return F.struct(*out, states.alias("states"), F.coalesce(whole & (size == F.octet_length(payload)), F.lit(False)).alias("header_ok"))


def assert_run(events: DataFrame, run: Column) -> DataFrame:
    """Events with run_mismatch; error events take the asked run, others keep theirs."""
    bad = F.col("run_number") != run
    return events.withColumn("run_mismatch", bad).withColumn("run_number", F.when(F.col("message_code") == "ERROR_EVENT", run).otherwise(F.col("run_number")))
