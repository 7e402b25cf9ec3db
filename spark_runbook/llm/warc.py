"""WARC records and the resolution of not-modified revisits.

Records are written and parsed as WARC/1.1 with HTTP heads (``to_warc``, ``parse_records``; ``read_warc`` takes files, gzip members too).
``resolve_revisits`` is an as-of join: a revisit (an HTTP 304) refers to the latest earlier full response of its canonical URL. If the
validators agree (entity tag, else last-modified date, else payload digest), it gets that response's payload and headers, with
those headers replaced that a 304 may update.

The as-of join sorts keys by range of (URL, time), so a URL with a third of all records is dealt over many tasks; what a range needs from
those before it is one row for each range and URL.

Defined results: URLs that are null or don't parse have no canonical form, and their revisits stay unresolved ("no_url");
a revisit without an earlier response is "no_response", with other validators "validator_mismatch"; equal times count as not earlier; a response
without a date is earlier than none, and a revisit without one finds none; of responses with equal URL and time the largest id counts, and of
several with one id the latest, then that with the largest digest and payload; repeated rows are kept; empty tables give empty results.
A record whose length is missing, wrong or beyond the end is a row with ``problem`` set, and reading goes on at the next head; so is a gzip member that is
damaged, cut off or fails its checksum, of which the records before the damage are read, and reading goes on at the next member. Repeated header
fields are joined by ", ", cookies by a line end. Payloads are bytes. Files are inflated a member's chunk at a time and a record is
held whole; Spark's reader takes files of up to 2 GB.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, give_back, heavy_keys, small_batches, spread_join

#: Header fields that a 304 may update in the stored response.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

RECORD = "record_id string, type string, url string, date timestamp, status int, headers map<string,string>, digest string, payload binary"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, http as https, no www or m label, default port, fragment, tracking parameters or trailing slash; null if it doesn't parse."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(u, r"(?i)^https?://(?:[^/@?]*@)?([^/:?]+)(?::(\d+))?(/[^?]*)?(?:\?(.*))?$", i)
    host = F.regexp_replace(F.lower(part(1)), r"^(?:www|m)\.", "")
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    path = F.regexp_replace(part(3), "/+$", "")
    kept = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(part(1) != "", F.concat(F.lit("https://"), host, port, path, query))


def to_warc(records: DataFrame) -> DataFrame:
    """record_id and warc: each record's bytes. records: columns of RECORD."""
    reason = F.when(F.col("status") == 304, "Not Modified").otherwise("OK")
    names = F.array_sort(F.map_keys("headers"))
    head = F.concat(
        F.lit("HTTP/1.1 "), F.col("status").cast("string"), F.lit(" "), reason, F.lit("\r\n"),
        F.array_join(F.transform(names, lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at("headers", k), F.lit("")), F.lit("\r\n"))), ""), F.lit("\r\n"),
    )
    body = F.concat(F.encode(head, "UTF-8"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    field = lambda name, c: F.when(c.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")))
    warc = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("type")), field("WARC-Record-ID", F.concat(F.lit("<urn:x:"), F.col("record_id"), F.lit(">"))), field("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        field("WARC-Date", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), F.lit("Content-Type: application/http\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return records.select("record_id", F.concat(F.encode(warc, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("warc"))


def _fields(block: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in block.split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if sep:
            k, v = name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")
            out[k] = v if k not in out else out[k] + ("\n" if k == "set-cookie" else ", ") + v
    return out


MEMBER = re.compile(rb"\x1f\x8b\x08")
PROBE = 256


def _opens(data) -> bool:
    """Whether what starts here can be inflated, as far as its first bytes tell."""
    d = zlib.decompressobj(31)
    try:
        d.decompress(data[:PROBE], PROBE)
    except zlib.error:
        return False
    return True


def _inflated(data):
    """The bytes of a file in chunks; gzip members are inflated as they are read, and what follows the last is passed on. A damaged member gives None where
    its bytes end, and reading goes on at the next place where a member opens."""
    data = memoryview(data)
    while bytes(data[:2]) == b"\x1f\x8b":
        d, at = zlib.decompressobj(31), 0
        try:
            while not d.eof and at < len(data):
                part, at = data[at : at + CHUNK], min(len(data), at + CHUNK)
                yield d.decompress(part, CHUNK)
                while d.unconsumed_tail:
                    yield d.decompress(d.unconsumed_tail, CHUNK)
            yield d.flush()
            if not d.eof:
                yield None
            data = data[at - len(d.unused_data) :] if d.eof else data[len(data) :]
        except zlib.error:
            yield None
            data = next((data[m.start() :] for m in MEMBER.finditer(data, 1) if _opens(data[m.start() :])), data[len(data) :])
    for at in range(0, len(data), CHUNK):
        yield bytes(data[at : at + CHUNK])


CHUNK = 1 << 20
HEAD = b"WARC/1."


def records_in(data):
    """Records of one WARC file or part of it, as tuples in the order of RECORD and the problem, if any."""
    chunks, buffer, done, damaged = (c for c in _inflated(data) if c is None or c), bytearray(), False, False

    def more() -> bool:
        nonlocal done, damaged
        if done or damaged:
            return False
        c = next(chunks, b"")
        done, damaged = c == b"", c is None
        buffer.extend(c or b"")
        return bool(c)

    def find(what: bytes, start: int) -> int:
        while (at := buffer.find(what, start)) < 0:
            start = max(start, len(buffer) - len(what) + 1)
            if not more():
                return -1
        return at

    while (at := find(HEAD, 0)) >= 0 or damaged:
        if at < 0:
            yield (None, None, None, None, None, [], None, None, "damaged member")
            buffer.clear()
            damaged = False
            continue
        del buffer[:at]
        end = find(b"\r\n\r\n", 0)
        f = _fields(bytes(buffer[: end if end >= 0 else len(buffer)]))
        size = int(f["content-length"]) if re.fullmatch(r"[0-9]{1,15}", f.get("content-length", "")) else -1
        stop = end + 4 + size
        while end >= 0 and size >= 0 and len(buffer) < stop and more():
            pass
        problem = "no end of head" if end < 0 else "no length" if size < 0 else "cut off" if len(buffer) < stop else None
        common = (f.get("warc-record-id", "").removeprefix("<urn:x:").strip("<>") or None, f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-date"))
        digest = (f.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        if problem:
            yield (*common, None, [], digest, None, problem)
            del buffer[: len(HEAD)]
            continue
        block = bytes(buffer[end + 4 : stop])
        del buffer[:stop]
        head, _, payload = block.partition(b"\r\n\r\n")
        m = re.match(rb"HTTP/\S+ (\d{3})", head)
        yield (*common, int(m[1]) if m else None, list(_fields(head.partition(b"\r\n")[2]).items()) if m else [], digest, payload if m else block, None)


def parse_records(files: DataFrame, content_col: str) -> DataFrame:
    """Columns of RECORD, and problem, from the bytes of WARC files or records."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for v in b.column(0):
                for r in records_in(v.as_buffer() if v.is_valid else b""):
                    rows.append(r)
                    size += len(r[7] or b"")
                    if len(rows) >= 500 or size > 4 * CHUNK:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)

    def batch(rows):
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["record_id", "type", "url", "date", "status", "headers", "digest", "payload", "problem"])

    small_batches(files.sparkSession)
    out = files.select(F.col(content_col)).mapInArrow(give_back(run), RECORD.replace("date timestamp", "date string") + ", problem string")
    return out.withColumn("date", F.try_to_timestamp("date"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return parse_records(spark.read.format("binaryFile").load(path), "content")


def as_of(rows: DataFrame, key: str, time: str, is_source: Column, source_id: str, ranges: int | None = None) -> DataFrame:
    """rows with found: the id of the latest source row of the same key that is earlier; null if there is none.
    rows needs unique-enough columns only: nothing is joined but ranges."""
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("__src", is_source)
    dealt = cut(marked.repartitionByRange(ranges, key, time, "__src", source_id).withColumn("__range", F.spark_partition_id()))
    order = [F.col(time), F.col("__src"), F.col(source_id)]  # at equal times, those that look come before sources
    before = Window.partitionBy("__range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(F.col(time).alias("t"), F.col(source_id).alias("i"))
    within = dealt.withColumn("__in", F.last(F.when(F.col("__src"), last), ignorenulls=True).over(before))
    ends = dealt.groupBy(key, "__range").agg(F.max(F.when(F.col("__src"), last)).alias("__end"))
    carried = ends.select(key, "__range", F.last("__end", ignorenulls=True).over(Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__carry")).where("__carry is not null")
    out = within.join(carried, [key, "__range"], "left").withColumn("found", F.coalesce("__in", "__carry")["i"])
    return out.drop("__in", "__carry", "__src", "__range")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row a revisit: record_id, canonical_url, response_id, outcome, headers (merged), digest, payload."""
    keyed = records.withColumn("canonical_url", canonical_url(F.col("url")))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    look = keyed.where(F.col("canonical_url").isNotNull() & F.col("date").isNotNull() & (full | (F.col("type") == "revisit"))).select("record_id", "canonical_url", "date", "type", "status")
    found = as_of(look, "canonical_url", "date", full, "record_id").where(F.col("type") == "revisit").select(F.col("record_id").alias("rid"), F.col("date").alias("rdate"), "found").distinct()
    revisit = keyed.where(F.col("type") == "revisit").select("record_id", "canonical_url", "date", "headers", "digest")
    revisit = revisit.join(found, (F.col("record_id") == F.col("rid")) & F.col("date").eqNullSafe(F.col("rdate")), "left")
    content = F.struct("headers", "digest", "payload")
    stored = keyed.where(full).groupBy(F.col("record_id").alias("found")).agg(F.max_by(content, F.struct("date", "digest", "payload")).alias("c"))
    stored = stored.select("found", F.col("found").alias("response_id"), F.col("c.headers").alias("stored"), F.col("c.digest").alias("sd"), F.col("c.payload").alias("payload"))
    revisit = cut(revisit)
    often = heavy_keys(revisit.where("found is not null").groupBy("found").count(), "found", "count")
    both = spread_join(revisit, stored, "found", often, F.col("record_id"), "left")
    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    since = lambda m: F.element_at(m, "last-modified")
    agrees = F.when(tag("headers").isNotNull() & tag("stored").isNotNull(), tag("headers") == tag("stored")).when(since("headers").isNotNull() & since("stored").isNotNull(), since("headers") == since("stored")).otherwise(F.coalesce(F.col("digest") == F.col("sd"), F.lit(False)))
    outcome = F.when(F.col("canonical_url").isNull(), "no_url").when(F.col("response_id").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.when(ok, F.col("response_id")).alias("response_id"), "outcome", F.when(ok, merged).alias("headers"), F.when(ok, F.col("sd")).alias("digest"), F.when(ok, F.col("payload")).alias("payload")
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records made from pages: every page is a full response, and is asked for again later. The second visit's validator is that
    of the page, but a changed one for every seventh."""
    html, page = F.coalesce("html", F.lit("")), F.col("page_id")
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(day) + s)
    tag = F.concat(F.lit('"'), F.substring(F.sha2(html, 256), 1, 16), F.lit('"'))
    http = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k.replace("_", "-")), v)))
    first = pages.select(
        F.concat(F.lit("r"), page.cast("string")).alias("record_id"), F.lit("response").alias("type"), "url", at(page % 86400).alias("date"), F.lit(200).alias("status"),
        http(etag=tag, content_type=F.lit("text/html"), cache_control=F.lit("max-age=60"), content_length=F.octet_length(html).cast("string"), server=F.lit("a")).alias("headers"), F.sha2(html, 256).alias("digest"), html.cast("binary").alias("payload"),
    )
    again = pages.select(
        F.concat(F.lit("v"), page.cast("string")).alias("record_id"), F.lit("revisit").alias("type"), "url", at(page % 86400 + 43200 * (page % 3)).alias("date"), F.lit(304).alias("status"),
        http(etag=F.when(page % 7 == 0, F.lit('"changed"')).otherwise(tag), cache_control=F.lit("max-age=600"), content_length=F.lit("0"), set_cookie=F.lit("s=1")).alias("headers"), F.sha2(html, 256).alias("digest"), F.lit(b"").alias("payload"),
    )
    return first.unionByName(again)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = resolve_revisits(parse_records(to_warc(captures(pages)), "warc"))
    flat = F.array_join(F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k))), "\n")
    return out.select(F.substring("record_id", 2, 30).cast("long").alias("page_id"), "canonical_url", F.substring("response_id", 2, 30).cast("long").alias("response_page_id"), "outcome", F.sha2(flat, 256).alias("headers_sha256"), F.sha2("payload", 256).alias("payload_sha256"))


OP5_SQL = r"""
WITH u AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS u, page_id % 86400 AS t0, page_id % 86400 + 43200 * (page_id % 3) AS t1,
           '"' || substr(sha256(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
p AS (SELECT *, regexp_extract(u, '(?i)^https?://(?:[^/@?]*@)?([^/:?]+)(?::(\d+))?(/[^?]*)?(?:\?(.*))?$', ['host', 'port', 'path', 'query']) AS x FROM u),
q AS (SELECT *, list_sort(list_filter(string_split(x.query, '&'), lambda s: s <> '' AND NOT regexp_matches(s, '(?i)^(?:utm_[^=]*|ref|fbclid|gclid)(?:=|$)'))) AS ps FROM p),
c AS (SELECT *, CASE WHEN x.host <> '' THEN 'https://' || regexp_replace(lower(x.host), '^(?:www|m)\.', '') || CASE WHEN x.port IN ('', '80', '443') THEN '' ELSE ':' || x.port END
      || regexp_replace(x.path, '/+$', '') || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END AS canonical_url FROM q),
f AS (SELECT v.page_id, v.canonical_url, v.tag, (SELECT max(struct_pack(t := r.t0, i := 'r' || r.page_id::VARCHAR)) FROM c r WHERE r.canonical_url = v.canonical_url AND r.t0 < v.t1) AS m FROM c v),
g AS (SELECT f.page_id, f.canonical_url, r.page_id AS rid, r.html, r.tag, CASE WHEN f.canonical_url IS NULL THEN 'no_url' WHEN r.page_id IS NULL THEN 'no_response'
      WHEN f.page_id % 7 <> 0 AND f.tag = r.tag THEN 'resolved' ELSE 'validator_mismatch' END AS outcome FROM f LEFT JOIN c r ON 'r' || r.page_id::VARCHAR = f.m.i)
SELECT page_id, canonical_url, CASE WHEN outcome = 'resolved' THEN rid END AS response_page_id, outcome,
       CASE WHEN outcome = 'resolved' THEN sha256('cache-control=max-age=600' || chr(10) || 'content-length=' || octet_length(encode(coalesce(html, '')))::VARCHAR || chr(10) || 'content-type=text/html' || chr(10) || 'etag=' || tag || chr(10) || 'server=a') END AS headers_sha256,
       CASE WHEN outcome = 'resolved' THEN sha256(coalesce(html, '')) END AS payload_sha256
FROM g
"""
