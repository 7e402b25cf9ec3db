"""Status codes of runs, streams and instances, as plain Columns. now is always given; ages are seconds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import secs


def age(now: Column, then: Column) -> Column:
    return F.abs(secs(now) - secs(then))


def open_status(created: Column, injected: Column, age_s: Column) -> Column:
    lag = created - injected
    return F.when((lag > 0) & (age_s > 360), 2).when(lag > 0, 1).otherwise(0)


def _lagging(lag: Column, age_s: Column, young: int, n: Column, old: Column) -> Column:
    return F.when(lag == 0, 0).when(age_s < young, F.when(lag > 630 * n, 3).when(lag > 100 * n, 2).otherwise(1)).otherwise(old)


def injected_check(new: Column, injected: Column, deleted: Column, n: Column, age_s: Column) -> Column:
    lag = injected - new
    return _lagging(lag, age_s, 1800, n, F.when(injected == deleted, F.when(lag > 0, 2).otherwise(1)).when(lag > 0, 3).otherwise(1))


def transferred_check(new: Column, copied: Column, n: Column, age_s: Column) -> Column:
    lag = new - copied
    return _lagging(lag, age_s, 1800, n, F.when(lag > 0, 3).otherwise(1))


def checked_check(checked: Column, copied: Column, n: Column, age_s: Column) -> Column:
    return _lagging(copied - checked, age_s, 900, n, F.lit(3))


def repacked_check(repacked: Column, not_repacked: Column, checked: Column, deleted: Column, age_s: Column) -> Column:
    more = checked > deleted
    return F.when(repacked == checked, 0).when(repacked == checked - not_repacked, 4).when((age_s > 378000) & more, 3).when((age_s > 14400) & more, 2).otherwise(1)


def trans_rate_check(write: Column, trans: Column, gb: Column, n: Column, span_s: Column) -> Column:
    slow = F.when(write < 20, trans < 0.1 * write).otherwise(((trans + 5 < 0.75 * write) & (trans < 900 * n / 16)) | ((trans < 0.5 * write) & (trans < 800 * n / 16)))
    return F.when((span_s > 360) & (write > 0) & (trans == 0), 3).when((gb > 50) & slow, 2).otherwise(0)


def notfiles_check2(u: Column, nodes: Column, age_s: Column) -> Column:
    f = F.when(nodes > 1, 0.25).otherwise(1.0)
    return F.when(u == 0, 0).when(u > 50 * (1 + f * nodes), 3).when(u > 24 * (1 + f * nodes), 2).when(age_s > 2700, 3).when(age_s > 1800, 2).otherwise(1)


def notfiles_check(u: Column, streams: Column, signed_age: Column) -> Column:
    at = lambda limit, k: ((signed_age > limit) & (u > 0)) | ((signed_age < limit) & (u > k * streams + 5))
    return F.when(at(2700, 5), 2).when(at(1800, 3), 1).otherwise(0)


def deleted_check(deleted: Column, checked: Column, repacked: Column, created: Column, hosts: Column, start: Column, last: Column, now: Column) -> Column:
    """Deletions behind their schedule; start and last transfer are times."""
    done = (deleted == checked) | (deleted == repacked) | (deleted == created)
    midnight = F.floor(secs(now) / 86400) * 86400
    late = midnight - secs(last)
    limit = 60 * (60 * 17 + 20)
    one = F.when(late > limit + 25 * 3600, 3).when(late > limit, 2).otherwise(1)
    d, off = 1200, 24000
    span = secs(last) - secs(start)
    a = F.abs(secs(now) - secs(last))
    part = F.coalesce(F.try_divide(deleted, checked), F.lit(1.0))
    share = lambda x: F.coalesce(1 - F.try_divide(x.cast("double"), span), F.lit(0.0))
    young = F.when(part < share(F.lit(off + d)), 3).when(part < share(F.lit(off - 3 * d)), 2).otherwise(1)
    old = F.when(deleted == repacked, 1).when(part < share(F.greatest(off + 21 * d - a, F.lit(0))), 3).when(part < share(F.greatest(off + 5 * d - a, F.lit(0))), 2).otherwise(1)
    return F.when(done, 0).when(hosts == 1, one).otherwise(F.when(a < 360, young).otherwise(old))


def instance_check(max_closed: Column, count: Column, previous: Column, missing: Column) -> Column:
    return F.when((count == 0) | missing, 2).when((max_closed > 25) & (count != previous), 1).otherwise(0)


def nevents_check(stream: Column, events: Column, most: Column) -> Column:
    ratio = most / (events + 1)
    return F.when(stream.contains("Error") & (most > 1000), F.when(ratio < 100, 2).when(ratio < 1000, 1).otherwise(0)).otherwise(0)


def write_status(mb_s: Column, max_instance: Column | None = None) -> Column:
    limit = (max_instance + 1) / 16 * 2000 if max_instance is not None else F.lit(2000)
    return F.when(mb_s < limit, 0).otherwise(1)


#: Stream name patterns and their codes.
STREAM_CODES = [("Error", 1), ("_DontNotifyT0", 2), ("_NoTransfer", 2), ("_TransferTest", 3), ("_NoRepack", 2)]


def stream_status(stream: Column) -> Column:
    return reduce(lambda acc, pc: F.when(stream.contains(pc[0]), pc[1]).otherwise(acc), reversed(STREAM_CODES), F.lit(0))


def setup_status(label: Column, code: int = 2) -> Column:
    return F.when(label.contains("TransferTest"), code).otherwise(0)


def pair_status(a: Column, b: Column, signed_age: Column) -> Column:
    """Two stages of an instance: equal 0, young 1, else 2 (a third case at 1200 s can't be reached)."""
    return F.when(a == b, 0).when(signed_age < 301, 1).otherwise(2)


def repacked_pair(a: Column, b: Column, signed_age: Column) -> Column:
    return F.when(a == b, 0).when(signed_age > 300, 2).otherwise(1)


def deleted_pair(deleted: Column, others: list[Column], signed_age: Column) -> Column:
    equal = reduce(lambda x, y: x | y, [deleted == o for o in others])
    return F.when(equal, 0).when(signed_age < 29555, 1).when(signed_age > 60550, 3).when(signed_age > 29550, 2).otherwise(1)


def na_or_round(x: Column, digits: int = 2) -> Column:
    """'NA' for 0 and null, else the rounded value."""
    return F.when(F.coalesce(x, F.lit(0)) == 0, "NA").otherwise(F.round(x, digits).cast("string"))


def run_of_file(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^.]+\.(\d+)\.", 1).cast("long")


def index_name(name: Column) -> Column:
    return F.regexp_replace(name, r"\.(?:dat|root)$", ".ind")


def join_limited(items: Column, n: int) -> Column:
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), F.when(F.size(items) > n, ", ...").otherwise(""))


def trim_spaces(text: Column) -> Column:
    return F.trim(text)


def escape_amp(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def selection_help(label: Column, names: Column) -> Column:
    return F.concat(F.lit("Output module "), label, F.lit(": "), F.array_join(names, ", "))
