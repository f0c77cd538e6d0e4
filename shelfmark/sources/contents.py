"""Bytes of files by ranges: heads, chunks or whole files, and nothing besides.

:func:`read_ranges` takes a table of ranges (file_id, path, offset, length). They are packed
into tasks by cumulative bytes (a file counts PER_FILE more, for the cost of opening
it), so a task reads about as much as any other, and one large file is a task of its own or,
as ranges, several. ``file_ranges`` is the same as a data source over a folder::

    spark.dataSource.register(FileRanges)
    spark.read.format("file_ranges").option("path", "/data").option("length", 2 << 20).load()

Its schema says what is wanted: without ``content`` no file is opened.

Paths are of any store that executors reach by ``pyarrow.fs`` (mounted folders, hdfs, s3, gs).
A file that can't be read gives its error and null content; a range beyond the end of a
file gives what there is. Batches hold BATCH_BYTES and one range more at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from shelfmark.operators import ordered

TASK_BYTES, BATCH_BYTES, PER_FILE = 64 << 20, 16 << 20, 4096
RANGES = "file_id long, path string, offset long, length long, size long, content binary, error string"


def opened(path: str):
    """The open file of a path or uri: ``read_at`` and ``size``."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(inner)


def _reads(rows: Iterable[tuple], wanted: bool = True) -> Iterator[tuple]:
    """(file_id, path, offset, length, size, content, error) of ranges (file_id, path, offset, length); neighbours of one file share its handle."""
    last, handle, error = None, None, None
    for file_id, path, offset, length in rows:
        if not wanted:
            yield file_id, path, offset, length, None, None, None
            continue
        if path != last:
            if handle is not None:
                handle.close()
            last, handle, error = path, None, None
            try:
                handle = opened(path)
            except (OSError, ValueError, AttributeError, TypeError) as e:
                error = str(e) or "no path"
        size = content = None
        if handle is not None:
            try:
                size = handle.size()
                n = size - offset if length is None or length < 0 else min(length, size - offset)
                content, why = handle.read_at(n, offset) if n > 0 else b"", None
            except OSError as e:
                why = str(e)
        else:
            why = error
        yield file_id, path, offset, length, size, content, why
    if handle is not None:
        handle.close()


_TYPES = {"file_id": pa.int64(), "path": pa.string(), "offset": pa.int64(), "length": pa.int64(), "size": pa.int64(), "content": pa.binary(), "error": pa.string()}
_NAMES = list(_TYPES)


def _batches(rows: Iterable[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Record batches of the named columns, cut by bytes."""
    at = [_NAMES.index(n) for n in names]
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], _TYPES[n]) for i, n in zip(at, names, strict=True)], names=names)

    for row in rows:
        held.append(row)
        size += len(row[5] or b"") + 64
        if size >= BATCH_BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def packed(rows: DataFrame, weight: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows (file_id, ...) dealt to as many tasks as their weights fill, about ``task_bytes`` each; a task's rows come in order of file_id."""
    at = ordered.packed(rows, weight + PER_FILE, task_bytes, ["file_id", *(["offset"] if "offset" in rows.columns else [])])
    top = at.agg(F.max("pack")).first()[0]
    if top is None:
        return at.drop("pack")
    keys = ["file_id", *(["offset"] if "offset" in rows.columns else [])]
    return at.repartitionById(int(top) + 1, F.col("pack").cast("int")).sortWithinPartitions(*keys).drop("pack")


def read_ranges(ranges: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """RANGES' columns of ``ranges`` (file_id, path, offset, length; no or a negative length: to the end, then ``size`` should say how long files are)."""
    sized = F.coalesce(F.when(F.col("length") >= 0, F.col("length")), F.col("size") if "size" in ranges.columns else F.lit(task_bytes))
    rows = packed(ranges, sized, task_bytes).select("file_id", "path", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_reads(rows), _NAMES)

    return rows.mapInArrow(run, RANGES)


def heads(files: DataFrame, length: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``files`` (file_id, path, ...) with ``content``, their first ``length`` bytes, and ``error``."""
    known = F.least(F.col("size"), F.lit(length)) if "size" in files.columns else F.lit(length)
    ranges = files.select("file_id", "path", F.lit(0).cast("long").alias("offset"), known.cast("long").alias("length"))
    return files.drop("content", "error").join(read_ranges(ranges, task_bytes).select("file_id", "content", "error"), "file_id")


def chunks(files: DataFrame, plan: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The planned chunks (an array of offset and len) of files as read ranges: RANGES' columns, a row a chunk."""
    ranges = files.select("file_id", "path", F.explode(plan).alias("c")).select("file_id", "path", F.col("c.offset").alias("offset"), F.col("c.len").alias("length"))
    return read_ranges(ranges, task_bytes)


class _Pack(InputPartition):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options = schema.names, options

    def partitions(self) -> list[_Pack]:
        """The files of the folder, packed by the bytes that are asked of each."""
        from pyarrow import fs

        root = self.options["path"]
        system, inner = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        offset, length, most = (int(self.options.get(k, d)) for k, d in (("offset", 0), ("length", -1), ("taskbytes", TASK_BYTES)))
        packs, held, size = [], [], 0
        for i, info in enumerate(sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path)):
            n = max(0, info.size - offset) if length < 0 else min(length, max(0, info.size - offset))
            n = n if "content" in self.names else 0
            if held and size + n + PER_FILE > most:
                packs.append(_Pack(held))
                held, size = [], 0
            held.append((i, f"{prefix}{info.path}", offset, n, info.size))
            size += n + PER_FILE
        return packs + [_Pack(held)] * bool(held)

    def read(self, partition: _Pack) -> Iterator[pa.RecordBatch]:
        """Ranges of one pack."""
        wanted = bool({"content", "error"} & set(self.names))
        got = _reads([r[:4] for r in partition.rows], wanted)
        yield from _batches(((*g[:4], row[4], *g[5:]) for g, row in zip(got, partition.rows, strict=True)), self.names)


class FileRanges(DataSource):
    """A range of every file below a folder; options path, offset, length, taskBytes."""

    @classmethod
    def name(cls) -> str:
        """Format name."""
        return "file_ranges"

    def schema(self) -> str:
        """All columns; give a schema of some of them to read no more."""
        return RANGES

    def reader(self, schema: StructType) -> _Reader:
        """Reader of the columns asked for."""
        return _Reader(schema, dict(self.options))
