"""Log files as a stream: lines are read as files grow, from the saved byte of each file on.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").load("/shared/logs/*.log")

An offset holds, for each file, where the last whole line ended and a checksum of the file's first bytes, so the query's checkpoint is the reader's memory: a
query that starts again goes on at the saved byte. A file that got shorter, or whose beginning has changed, is a new one: a row with a
warning comes first, then its lines from the beginning. What a file has grown by is read in ranges of bytes by several tasks; a line belongs to
the range that it begins in. A last line without its end waits until it is whole.

Paths may be of any file system that Arrow reads (local, hdfs, s3, ...); one ``*`` pattern in the last part. Names that begin with a point or an underscore aren't read.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD, CHUNK = 256, 1 << 20
RANGE_BYTES = 16 << 20
LINES = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("line", pa.string()), ("warning", pa.string())])


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """Files of a folder or pattern, with their sizes."""
    fs, at = opened(path)
    folder, _, pattern = at.rstrip("/").rpartition("/") if "*" in at.rsplit("/", 1)[-1] else (at.rstrip("/"), "", "*")
    found = fs.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))
    return {f.path: f.size for f in found if f.type == arrow_fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern)}


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, first: bool, warning: str | None = None):
        self.file, self.start, self.end, self.first, self.warning = file, start, end, first, warning


class Tail:
    """What the stream and its tests need of files: states, ranges and lines."""

    def __init__(self, path: str, range_bytes: int = RANGE_BYTES):
        self.path, self.range_bytes = path, range_bytes

    def _head(self, fs, file: str, n: int) -> int:
        with fs.open_input_file(file) as f:
            return zlib.crc32(f.read(n))

    def _whole(self, fs, file: str, size: int) -> int:
        """Where the last line that is whole ends, searched from the end."""
        with fs.open_input_file(file) as f:
            at = size
            while at > 0:
                start = max(0, at - CHUNK)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return start + found + 1
                at = start
        return 0

    def state(self) -> dict:
        fs, _ = opened(self.path)
        out = {}
        for file, size in sorted(listed(self.path).items()):
            end = self._whole(fs, file, size)
            n = min(HEAD, end)
            out[file] = {"end": end, "head_bytes": n, "head": self._head(fs, file, n)}
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        fs, _ = opened(self.path)
        out = []
        for file, now in end.items():
            was = start.get(file, {"end": 0, "head_bytes": 0, "head": 0})
            at, warning = was["end"], None
            if now["end"] < at:
                at, warning = 0, f"got shorter: {now['end']} < {was['end']}"
            elif was["head_bytes"] and self._head(fs, file, was["head_bytes"]) != was["head"]:
                at, warning = 0, "begins otherwise than before"
            if warning:
                out.append(Range(file, was["end"], was["end"], True, warning))
            out += [Range(file, a, min(a + self.range_bytes, now["end"]), a == at) for a in range(at, now["end"], self.range_bytes)]
        return out

    def lines(self, r: Range) -> Iterator[pa.RecordBatch]:
        if r.warning:
            yield pa.RecordBatch.from_pylist([{"file": r.file, "offset": r.start, "line": None, "warning": r.warning}], LINES)
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(r.file) as f:
            # a range behind the first begins with the line that begins there or behind it
            at = r.start if r.first else r.start - 1
            f.seek(at)
            buffer, skip = b"", not r.first
            while at < r.end:
                cut = buffer.rfind(b"\n")
                while cut < 0:
                    more = f.read(CHUNK)
                    if not more:
                        return
                    buffer += more
                    cut = buffer.rfind(b"\n")
                starts, texts = [], []
                for line in buffer[:cut].split(b"\n"):
                    if not skip and at < r.end:
                        starts.append(at)
                        texts.append(line.decode("utf-8", "replace"))
                    skip, at = False, at + len(line) + 1
                buffer = buffer[cut + 1 :]
                if texts:
                    yield pa.RecordBatch.from_arrays([pa.array([r.file] * len(texts)), pa.array(starts, pa.int64()), pa.array(texts), pa.nulls(len(texts), pa.string())], schema=LINES)


class _Stream(DataSourceStreamReader):
    def __init__(self, tail: Tail):
        self.tail = tail

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.tail.state()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.tail.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.tail.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class _Table(DataSourceReader):
    def __init__(self, tail: Tail):
        self.tail = tail

    def partitions(self) -> list[Range]:
        return self.tail.ranges({}, self.tail.state())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.tail.lines(partition)


class LogTail(DataSource):
    """Lines of log files: file, offset (where the line begins), line, warning. Option ``rangeBytes``: most bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, offset long, line string, warning string"

    def _tail(self) -> Tail:
        return Tail(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def reader(self, schema) -> _Table:
        return _Table(self._tail())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self._tail())
