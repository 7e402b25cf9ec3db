"""Message fragments of five kinds in binary files: a data source that reads files in ranges of bytes and finds its way back behind damage.

    spark.dataSource.register(Frames)
    pack(fragments).write.format("frames").mode("append").save("/shared/frames")
    spark.read.format("frames").load("/shared/frames")

A frame is ``SYNC``, a header, the payload and a CRC-32 of both. Inside a frame the first three bytes of SYNC are always followed by a zero, so SYNC is found at the
beginning of frames only and a range can begin anywhere: a frame belongs to the range that its SYNC begins in, and ends at the next SYNC. What isn't a whole frame is a row with
``problem``: bytes before the first SYNC, frames that are too short, fail their checksum or are of no known kind.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .tail import RANGE_BYTES, listed, opened

SYNC = b"\xf5\xa3\x1c\x7e"
KINDS = {1: "INIT", 2: "EVENT", 3: "DQM", 4: "END_LUMI", 5: "ERROR_EVENT"}
#: Header fields, big-endian: name and bytes.
FIELDS = [("code", 1), ("run_number", 4), ("event_number", 8), ("lumi_section", 4), ("originator_pid", 4), ("originator_guid", 4), ("secondary_id", 4), ("frame_index", 2), ("num_frames", 2)]
HEADER_BYTES = sum(n for _, n in FIELDS)
CHUNK = 1 << 20
SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), *((n, pa.int64()) for n, _ in FIELDS), ("payload", pa.binary()), ("problem", pa.string())])
BATCH_BYTES = 4 << 20


def frame(fields: dict[str, Column], payload: Column) -> Column:
    """The bytes of a frame."""
    head = F.unhex(F.concat(*(F.lpad(F.hex(F.coalesce(fields.get(n, F.lit(0)), F.lit(0)).cast("long")), 2 * size, "0") for n, size in FIELDS)))
    body = F.concat(head, F.coalesce(payload, F.lit(b"")))
    whole = F.concat(body, F.unhex(F.lpad(F.hex(F.crc32(body)), 8, "0")))
    latin = lambda b: b.decode("latin-1")
    stuffed = F.encode(F.replace(F.decode(whole, "ISO-8859-1"), F.lit(latin(SYNC[:3])), F.lit(latin(SYNC[:3] + b"\0"))), "ISO-8859-1")
    return F.concat(F.lit(SYNC), stuffed)


def pack(fragments: DataFrame, payload: str = "payload") -> DataFrame:
    """frame, of rows with the header's fields (missing ones are 0)."""
    return fragments.select(frame({n: F.col(n) for n, _ in FIELDS if n in fragments.columns}, F.col(payload)).alias("frame"))


def parsed(body: bytes) -> tuple[dict, str | None]:
    """Fields of what stands between two SYNCs, or why it is no frame."""
    whole = body.replace(SYNC[:3] + b"\0", SYNC[:3])
    if len(whole) < HEADER_BYTES + 4:
        return {}, "short"
    if zlib.crc32(whole[:-4]) != int.from_bytes(whole[-4:], "big"):
        return {}, "checksum"
    out, at = {}, 0
    for name, n in FIELDS:
        out[name] = int.from_bytes(whole[at : at + n], "big")
        at += n
    out["kind"], out["payload"] = KINDS.get(out["code"]), whole[HEADER_BYTES:-4]
    return out, None if out["kind"] else "unknown kind"


@dataclass
class Bytes:
    file: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[Bytes]


#: A task reads ranges of so many bytes in all (one at least), so small ranges don't make as many tasks.
TASK_BYTES = 8 << 20


def frames_in(part: Bytes, chunk: int = CHUNK) -> Iterator[tuple[int, dict, str | None]]:
    """(offset, fields, problem) of the frames that begin in a range."""
    fs, _ = opened(part.file)
    with fs.open_input_file(part.file) as f:
        f.seek(part.start)
        buffer, base, ended = b"", part.start, False

        def find(start: int) -> int:
            nonlocal buffer, ended
            while (at := buffer.find(SYNC, start)) < 0 and not ended:
                start = max(start, len(buffer) - len(SYNC) + 1)
                more = f.read(chunk)
                ended = not more
                buffer += more
            return at

        at = find(0)
        if part.start == 0 and at != 0:
            if buffer[: at if at >= 0 else None]:
                yield 0, {}, "no frame"
        while at >= 0 and base + at < part.end:
            stop = find(at + len(SYNC))
            fields, problem = parsed(buffer[at + len(SYNC) : stop if stop >= 0 else None])
            yield base + at, fields, problem
            if stop < 0:
                return
            base, buffer, at = base + stop, buffer[stop:], 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Ranges]:
        out, size = [], TASK_BYTES
        for file, length in sorted(listed(self.path).items()):
            for a in range(0, length, self.range_bytes):
                part = Bytes(file, a, min(a + self.range_bytes, length))
                if size + part.end - part.start > TASK_BYTES:
                    out.append(Ranges([]))
                    size = 0
                out[-1].ranges.append(part)
                size += part.end - part.start
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for part in partition.ranges:
            for offset, fields, problem in frames_in(part, min(CHUNK, max(1 << 16, self.range_bytes))):
                rows.append({"file": part.file, "offset": offset, "problem": problem, **fields})
                size += len(fields.get("payload", b"")) + 200
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceArrowWriter):
    """A file a task, hidden until all are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.bin"
        with fs.open_output_stream(f"{at}/_{name}") as out:
            for batch in iterator:
                for v in batch.column(0):
                    if v.is_valid:
                        out.write(v.as_buffer())
        return _Written(name)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        new = [m.name for m in messages if m]
        if self.overwrite:
            for file in listed(self.path):
                fs.delete_file(file)
        for name in new:
            fs.move(f"{at}/_{name}", f"{at}/{name}")

    def abort(self, messages) -> None:
        fs, at = opened(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{at}/_{m.name}")


class Frames(DataSource):
    """Columns: file, offset, kind, the header's fields, payload, problem; written from one column of frames. Option ``rangeBytes``: bytes of a range; a task reads ranges of TASK_BYTES in all, or one that is larger."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return f"file string, offset long, kind string, {', '.join(f'{n} long' for n, _ in FIELDS)}, payload binary, problem string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)
