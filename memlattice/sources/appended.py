"""Append-only JSON-lines files by byte offset: batch, increments, tail and stream.

A file is cut into byte ranges, and a range gives the lines that begin in it, so one
large file is read by many tasks.  A last line without its line feed is still being
written and waits.  How far a file was read is a number of bytes with a digest of what
stands before them; a file that became shorter, or whose earlier bytes changed, is
noticed when it is read on.

Files are opened through Arrow's file systems, by URI or absolute path.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "appended_lines"
SCHEMA = "source string, offset long, n_bytes long, line string"
#: Bytes of a range, of a block that is read at a time, and of either end of a file's read part that its digest covers.
RANGE, BLOCK, EDGE = 64 << 20, 1 << 20, 4096

#: Of each file the bytes read so far and their digest.
State = dict[str, tuple[int, str]]


class Rewritten(RuntimeError):
    """A file is shorter than what was read of it, or begins with other bytes."""


@dataclass(frozen=True)
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    size: int


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


def files_below(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of all files below a folder but hidden ones and those that start with "_"."""
    system, root = _located(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _whole_lines(file: pa.NativeFile, size: int) -> int:
    """Bytes up to the last line feed, read from the end."""
    while size > 0:
        start = max(0, size - BLOCK)
        file.seek(start)
        at = file.read(size - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        size = start
    return 0


def _digest(file: pa.NativeFile, at: int, whole: bool) -> str:
    out = hashlib.sha256(str(at).encode())
    parts = [(0, at)] if whole else [(0, min(at, EDGE)), (max(0, at - EDGE), at)]
    for start, stop in parts:
        file.seek(start)
        while start < stop:
            block = file.read(min(BLOCK, stop - start))
            if not block:
                break
            out.update(block)
            start += len(block)
    return out.hexdigest()


def state(path: str, whole: bool = False) -> State:
    """How far each file can be read now; ``whole`` digests all bytes and not only both ends of them."""
    system, _ = _located(path)
    out = {}
    for name, size in files_below(path):
        with system.open_input_file(name) as file:
            at = _whole_lines(file, size)
            out[name] = (at, _digest(file, at, whole))
    return out


def ranges(path: str, seen: State, until: State, size: int = RANGE, whole: bool = False, restart: bool = False) -> list[ByteRange]:
    """The byte ranges from ``seen`` to ``until``; a rewritten file is an error, or with ``restart`` read from its start."""
    system, _ = _located(path)
    out = []
    gone = sorted(set(seen) - set(until))
    if gone and not restart:
        raise Rewritten(f"no longer there: {gone[:5]}")
    for name, (end, _) in sorted(until.items()):
        start, known = seen.get(name, (0, ""))
        if start:
            with system.open_input_file(name) as file:
                if end < start or _digest(file, start, whole) != known:
                    if not restart:
                        raise Rewritten(f"{name}: the first {start} bytes are not those that were read")
                    start = 0
        out += [ByteRange(name, at, min(at + size, end), end) for at in range(start, end, size)]
    return out


def lines(path: str, part: ByteRange) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in a range."""
    system, _ = _located(path)
    with system.open_input_file(part.path) as file:
        at = part.start
        held = b""
        if at:  # the byte before tells whether a line begins here
            file.seek(at - 1)
            at -= 1
        first = at < part.start
        while True:
            block = file.read(min(BLOCK, part.size - at - len(held)))
            if not block:
                return  # what is held has no line feed yet
            whole = held + block
            begin = 0
            while (feed := whole.find(b"\n", max(begin, len(held) if begin == 0 else 0))) >= 0:
                if first:
                    first = False
                elif at + begin < part.stop:
                    yield at + begin, whole[begin:feed]
                else:
                    return
                begin = feed + 1
            if at + begin >= part.stop and not first:
                return
            at, held = at + begin, whole[begin:]


def _batches(path: str, part: ByteRange) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def batch() -> pa.RecordBatch:
        at, raw = zip(*rows, strict=True)
        text = [r.decode("utf-8", "replace") for r in raw]
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(at, pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(text)], names=["source", "offset", "n_bytes", "line"])

    for row in lines(path, part):
        rows.append(row)
        size += len(row[1])
        if len(rows) == 10_000 or size > 4 * BLOCK:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class AppendedLines(DataSource):
    """Options: path, rangeBytes, seen and until (states as JSON), digest (edges or whole), onRewrite (fail or restart), tailBytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _Stream(self.options)


class _Reader:
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.whole, self.restart = options.get("digest", "edges") == "whole", options.get("onRewrite", "fail") == "restart"
        self.seen, self.until = (json.loads(options.get(k, "null")) for k in ("seen", "until"))
        self.tail = int(options.get("tailBytes", 0))

    def cut(self, seen: State, until: State) -> Sequence[InputPartition]:
        return ranges(self.path, seen, until, self.size, self.whole, self.restart)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        return _batches(self.path, partition) if partition else iter(())  # without partitions Spark asks for one that is None


class _Batch(_Reader, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        until = self.until or state(self.path, self.whole)
        if self.tail:
            return [ByteRange(name, at, min(at + self.size, end), end) for name, (end, _) in sorted(until.items()) for at in range(max(0, end - self.tail), end, self.size)]
        return self.cut(self.seen or {}, until)


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets are states, so a query that starts again from its checkpoint notices what happened meanwhile."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": self.seen or {}}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": state(self.path, self.whole)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.cut(start["files"], end["files"])


def _format(spark: SparkSession, reader, path: str, options: dict):
    spark.dataSource.register(AppendedLines)
    return reader.format(NAME).options(**{k: str(v) for k, v in options.items()}).load(path)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """``source``, ``offset`` in bytes, ``n_bytes``, ``line`` of every whole line; bytes that are no UTF-8 are replaced in ``line`` only."""
    return _format(spark, spark.read, path, options)


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same rows as they are written; each micro-batch reads from byte to byte."""
    return _format(spark, spark.readStream, path, options)


def increment(spark: SparkSession, path: str, seen: State, whole: bool = False, **options) -> tuple[DataFrame, State]:
    """The lines written since ``seen`` (a state; empty: all), and the state to go on from.

    The end is fixed now, so the frame can be read again and gives the same lines.
    """
    until = state(path, whole)
    sent = {"seen": json.dumps(seen), "until": json.dumps(until), "digest": "whole" if whole else "edges"}
    return read(spark, path, **sent, **options), until


def tail(spark: SparkSession, path: str, most_bytes: int, most_rows: int, **options) -> DataFrame:
    """Of each file the last ``most_rows`` whole lines among those that begin in its last ``most_bytes`` whole-line bytes."""
    found = read(spark, path, tailBytes=most_bytes, **options)
    last = Window.partitionBy("source").orderBy(F.desc("offset"))
    return found.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= most_rows).drop("_r")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` with ``record`` (null where the line is no JSON object of the schema) and ``content_hash``."""
    return rows.withColumns({"record": F.from_json("line", schema), "content_hash": F.sha2(F.col("line").cast("binary"), 256)})
