"""Files by name: a data source that writes rows to the files that they name, and the checksums of a folder's files.

    spark.dataSource.register(NamedFiles)
    rows.repartition("name").sortWithinPartitions("name", "line").select("name", "data").write.format("named_files").mode("append").save("/shared/sink")
    checksums(spark, "/shared/sink/*")

For many small files: all that costs something a file (to list, open, read and write it) is done by tasks, and the driver sees a folder a task. Spark's own
writer makes a folder of each key, which its readers then list one by one and plan on the driver. Files are read in pieces, so they may be of any size.

Paths may be of any file system that Arrow reads (local, hdfs, s3, ...). Names that begin with a point or an underscore aren't read.
"""

from __future__ import annotations

import fnmatch
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileInfo, FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .tail import CHUNK, opened

BATCH = 10_000


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None  # none: no rows


class _Writer(DataSourceArrowWriter):
    """A folder a task, hidden until all are there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = opened(self.path)
        folder, name, out = uuid.uuid4().hex, None, None
        try:
            for batch in iterator:
                data, runs, at = batch.column(1).cast(pa.large_binary()).to_pylist(), pc.run_end_encode(batch.column(0)), 0
                for new, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                    if new != name:
                        if name is None:
                            fs.create_dir(f"{root}/_{folder}", recursive=True)
                        elif new < name:
                            raise ValueError(f"rows aren't sorted by name: {new} behind {name}")
                        else:
                            out.close()
                        name, out = new, fs.open_output_stream(f"{root}/_{folder}/{new}")
                    out.write(b"".join(d or b"" for d in data[at:end]))
                    at = end
        finally:
            if out:
                out.close()
        return _Written(folder if out else None)

    def commit(self, messages) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            if m and m.folder:
                fs.move(f"{root}/_{m.folder}", f"{root}/{m.folder}")

    def abort(self, messages) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m and m.folder:
                fs.delete_dir(f"{root}/_{m.folder}")


class NamedFiles(DataSource):
    """Writes two columns, a file's name and data (string or binary; null: nothing), of rows sorted by name within partitions, a name's all in one partition."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("named_files only appends")
        return _Writer(self.options["path"])


def _children(fs, at: str) -> list[FileInfo]:
    """What a folder holds; a file holds nothing."""
    if fs.get_file_info(at).type == FileType.File:
        return []
    return [x for x in fs.get_file_info(FileSelector(at)) if x.base_name[0] not in "._"]


def _files(fs, at: str) -> Iterator[str]:
    """A file itself, or the files of a folder and of its partition folders (k=v)."""
    if fs.get_file_info(at).type == FileType.File:
        yield at
        return
    left = [at]
    while left:
        for x in _children(fs, left.pop()):
            if x.type == FileType.File:
                yield x.path
            elif "=" in x.base_name:
                left.append(x.path)


def _adler32(fs, at: str) -> int:
    out = 1
    with fs.open_input_stream(at) as f:
        while piece := f.read(CHUNK):
            out = zlib.adler32(piece, out)
    return out


def _each(base: str, f: Callable) -> Callable:
    """For mapInArrow: rows f(file system, path) of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(base)
        rows = []
        for batch in batches:
            for at in batch.column(0).to_pylist():
                for row in f(fs, at):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_pylist(rows)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return run


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, adler32 of a file, of the files of a folder, or of all that a pattern names; empty files too."""
    parts, n = path.rstrip("/").split("/"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
    base = "/".join(parts[:first])
    found = spark.createDataFrame([(opened(base)[1],)], "file string")
    for p in parts[first:]:
        named = lambda fs, at, p=p: ({"file": x.path} for x in _children(fs, at) if fnmatch.fnmatchcase(x.base_name, p))
        found = found.mapInArrow(_each(base, named), "file string").repartition(n)
    files = found.mapInArrow(_each(base, lambda fs, at: ({"file": x} for x in _files(fs, at))), "file string").repartition(n)
    return files.mapInArrow(_each(base, lambda fs, at: [{"file": at, "adler32": _adler32(fs, at)}]), "file string, adler32 long")
