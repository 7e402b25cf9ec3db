"""Selection and routing: boolean trigger expressions compiled to Columns, streams, consumers, prescales and sampling."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import join_keys, scan

PASS = 1


class SelectionError(ValueError):
    """The expression or list can't be compiled for this menu."""


def match_triggers(pattern: str, names: list[str]) -> list[int]:
    """Places in the menu that the pattern (``*`` and ``?``) names."""
    rule = re.compile(fnmatch.translate(pattern.replace("[", "[[]")))
    return [i for i, n in enumerate(names) if rule.match(n)]


def _passes(states: Column, i: int) -> Column:
    return F.coalesce(F.get(states, F.lit(i)) == PASS, F.lit(False))


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def _named(name: str, names: list[str], states: Column) -> Column:
    must = name.endswith("@")
    found = match_triggers(name.rstrip("@"), names)
    if must and not found:
        raise SelectionError(f"no trigger matches {name!r}")
    return _any([_passes(states, i) for i in found])


def trigger_expr(expr: str, names: list[str], states: Column) -> Column:
    """A Column for the expression: ``||`` binds least, then ``&&``, then ``!``; brackets; ``.OR.`` and ``.AND.``; names with wildcards; blank or ``*`` is all.

    Only state 1 counts as passed. A name that matches nothing is false, or an error with ``@`` behind it.
    """
    expr = re.sub(r"\.OR\.", "||", re.sub(r"\.AND\.", "&&", expr))
    if expr.strip() in ("", "*"):
        return F.lit(True)
    tokens = [t for t in re.findall(r"\|\||&&|[!()]|[^\s!()|&]+|\S", expr)]
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def level(op: str, below) -> Column:
        parts = [below()]
        while peek() == op:
            take()
            parts.append(below())
        return reduce((lambda a, b: a | b) if op == "||" else (lambda a, b: a & b), parts)

    def factor() -> Column:
        t = peek()
        if t is None:
            raise SelectionError(f"an operand is missing in {expr!r}")
        take()
        if t == "!":
            return ~factor()
        if t == "(":
            inner = level("||", lambda: level("&&", factor))
            if peek() != ")":
                raise SelectionError(f"unequal brackets in {expr!r}")
            take()
            return inner
        if t in ("||", "&&", ")", "|", "&"):
            raise SelectionError(f"unexpected {t!r} in {expr!r}")
        return _named(t, names, states)

    out = level("||", lambda: level("&&", factor))
    if at != len(tokens):
        raise SelectionError(f"unexpected {peek()!r} in {expr!r}")
    return out


def select_events(paths: list[str], names: list[str], states: Column) -> Column:
    """Any of the patterns; ``!p`` is its negation, ``*`` or an empty list is all."""
    if not paths or "*" in paths:
        return F.lit(True)
    return _any([~_named(p[1:], names, states) if p.startswith("!") else _named(p, names, states) for p in paths])


def decode_trigger_bits(bits: Column, n: Column | int) -> Column:
    """States of n paths from their bytes: two bits each, four to a byte, low bits first."""
    n = F.lit(n) if isinstance(n, int) else n
    byte = lambda i: F.conv(F.hex(F.substring(bits, (F.floor(i / 4) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: (byte(i) / F.pow(F.lit(4), i % 4)).cast("int") % 4)).otherwise(F.array().cast("array<int>"))


def encode_trigger_bits(states: list[int]) -> bytes:
    out = bytearray(-(-len(states) // 4))
    for i, s in enumerate(states):
        out[i // 4] |= (s & 3) << (2 * (i % 4))
    return bytes(out)


def fraction_to_disk(fraction: float, key: Column) -> Column:
    """A repeatable sample: 0 none, 1 all, else keys whose remainder of a million is below the fraction."""
    if fraction <= 0:
        return F.lit(False)
    return F.lit(True) if fraction >= 1 else F.pmod(key, F.lit(1_000_000)) < int(fraction * 1_000_000)


def prescale(events: DataFrame, n: int, by: list[str], order: list[str], chunks: int | None = None) -> DataFrame:
    """Every n-th row of each group (null is one) in the given order, by a running count over ranges: no group meets in one task."""
    if n <= 1:
        return events
    return scan(events, by, order, chunks, __r=("count", F.lit(1), True)).where(F.col("__r") % n == 0).select(*events.columns)


@dataclass
class Stream:
    """One stream's rules. The expression counts if it isn't blank, else the list, else all."""

    name: str
    module: str | None = None
    expression: str = ""
    paths: list[str] = field(default_factory=list)
    fraction: float = 1.0
    max_mb: int = 0
    kind: str = "event"


@dataclass
class Consumer:
    name: str
    module: str
    expression: str = ""
    paths: list[str] = field(default_factory=list)
    prescale: int = 1
    unique: bool = False
    queue: int = 10


def chosen(rule: Stream | Consumer, names: list[str], states: Column) -> Column:
    return trigger_expr(rule.expression, names, states) if rule.expression.strip() else select_events(rule.paths, names, states)


def accepts(s: Stream, names: list[str], states: Column, module: Column, key: Column) -> Column:
    """Cheap tests first: fraction 0, module, bits, sample."""
    if s.fraction <= 0:
        return F.lit(False)
    ok = (module == s.module) if s.module else F.lit(True)
    return ok & chosen(s, names, states) & fraction_to_disk(s.fraction, key)


def route_to_streams(events: DataFrame, streams: list[Stream], names: list[str], states: Column, module: Column, key: Column) -> DataFrame:
    """A row for each event and accepting stream (column stream); one projection and an explode, no join."""
    tags = F.filter(F.array(*(F.when(accepts(s, names, states, module, key), F.lit(s.name)) for s in streams)), lambda t: t.isNotNull())
    return events.withColumn("stream", F.explode(tags))


def stream_tags(events: DataFrame, streams: list[Stream], names: list[str], states: Column, module: Column, key: Column) -> DataFrame:
    return events.withColumn("tags", F.filter(F.array(*(F.when(accepts(s, names, states, module, key), F.lit(s.name)) for s in streams)), lambda t: t.isNotNull()))


def unwanted(tagged: DataFrame) -> DataFrame:
    """Events that no stream takes."""
    return tagged.where(F.size("tags") == 0)


def route_to_consumers(events: DataFrame, consumers: list[Consumer], names: list[str], states: Column, module: Column) -> DataFrame:
    tags = F.filter(F.array(*(F.when((module == c.module) & chosen(c, names, states), F.lit(c.name)) for c in consumers)), lambda t: t.isNotNull())
    return events.withColumn("consumer", F.explode(tags))


def shared_queues(consumers: list[Consumer]) -> dict[str, str]:
    """Consumer to the queue that it reads: those that ask to be unique and select alike share the first one's."""
    first: dict[tuple, str] = {}
    out = {}
    for c in consumers:
        key = (c.module, c.expression, tuple(c.paths), c.prescale, c.queue) if c.unique else (c.name,)
        out[c.name] = first.setdefault(key, c.name)
    return out


SELECTION = ["module", "expression", "paths", "prescale", "queue"]


def with_queue(consumers: DataFrame, order: str) -> DataFrame:
    """Registered consumers with queue_name: those that ask to be unique and select alike (null is a value like others) read the queue of the first of them in order, others have one of their
    own. consumers: name, is_unique, order, and the columns of SELECTION."""
    shared = consumers.where("is_unique").groupBy(*SELECTION).agg(F.min_by("name", order).alias("__first"))
    named = join_keys(consumers, shared, SELECTION, "left")
    return named.withColumn("queue_name", F.when(F.col("is_unique"), F.col("__first")).otherwise(F.col("name"))).drop("__first")


def queue_readers(consumers: DataFrame, order: str) -> DataFrame:
    """A row a queue: its selection, how many consumers read it, and the first and last to register."""
    return with_queue(consumers, order).groupBy("queue_name", *SELECTION).agg(F.count("*").alias("n_readers"), F.min(order).alias("first"), F.max(order).alias("last"))


def route_dqm(updates: DataFrame, consumers: DataFrame, now: Column) -> DataFrame:
    """A row for each update and consumer of its folder (``*``: all) that isn't stale. consumers: name, folder, last_contact, timeout_s; a small dimension by nature."""
    live = consumers.where(F.unix_timestamp(now) - F.unix_timestamp("last_contact") <= F.col("timeout_s"))
    folders = updates.select("top_folder").distinct()
    wanted = folders.join(F.broadcast(live), (F.col("folder") == "*") | (F.col("folder") == F.col("top_folder"))).select("top_folder", F.col("name").alias("consumer"))
    return join_keys(updates, wanted, ["top_folder"])


def classify_message(code: Column) -> Column:
    """Kind of a message from its code; what isn't known is faulty."""
    kinds = {"INIT": "INIT", "EVENT": "DATA", "ERROR_EVENT": "ERROR", "DQM": "DQM", "END_LUMI": "EOLS"}
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), code), F.lit("FAULTY"))


def first_init(init: DataFrame, order: list[str]) -> DataFrame:
    """The first INIT message of each module id; empty labels are refused."""
    r = F.row_number().over(Window.partitionBy("output_module_id").orderBy(*order))
    return init.where(F.coalesce("label", F.lit("")) != "").withColumn("__r", r).where("__r = 1").drop("__r")


def with_init(events: DataFrame, init: DataFrame) -> DataFrame:
    """Events with the label of their module; init has a row a module."""
    return events.join(init, "output_module_id", "left")


def drop_old_lumis(updates: DataFrame, late: int, order: list[str], by: str = "run_number") -> DataFrame:
    """Drops an update whose lumi section lies more than ``late`` behind the largest of its run so far; 0 keeps all. A run of any number of updates is
    scanned in ranges. An update without a section stays."""
    if late == 0:
        return updates
    top = scan(updates, [by], order, __m=("max", F.col("lumi_section"), True))
    return top.where(F.coalesce(F.col("lumi_section") + late >= F.col("__m"), F.lit(True))).select(*updates.columns)


def no_transfer(files: DataFrame) -> DataFrame:
    """Files that are booked: not of streams that stay where they are."""
    return files.where(~F.col("stream").rlike("^EcalCalibration|_EcalNFS$|_NoTransfer$"))


def lookarea_sample(files: DataFrame, every: int, hosts: int, lumi: str = "lumisection", instance: str = "instance", counter: str = "counter") -> DataFrame:
    return files.where((F.col(lumi) % (every * hosts) == every * F.col(instance) + 1) & (F.col(counter) < 1))


def report_filter(runs: tuple[int, int] | None = None, host: str | None = None, contains: str | None = None, lacks: str | None = None) -> Column:
    """The given conditions, all of them."""
    parts = [F.lit(True)]
    if runs:
        parts.append(F.col("runnumber").between(*runs))
    if host:
        parts.append(F.col("hostname") == host)
    if contains:
        parts.append(F.col("filename").contains(contains))
    if lacks:
        parts.append(~F.col("filename").contains(lacks))
    return reduce(lambda a, b: a & b, parts)
