"""JSON lines by line number (SRC3): any run of lines, bad lines by number, a flag at the end; batch and stream.

Counting lines needs every byte once, reading a run of them does not.  ``index_lines`` cuts the files into byte ranges
and counts line starts in all ranges in parallel; the index has one small row for each range.  The data source
``line_batches`` then opens only the ranges a run of lines touches, one partition each, and seeks to them.  A line belongs
to the range in which it starts, so ranges need no agreement about line ends.

As a stream the offset is a line number.  Lines that are appended to the last file (and new files behind it) are counted
from where the index ends, an unfinished last line waits for its end, and a restarted query goes on behind the last line it
committed.  Files are read through pyarrow's file systems, so paths may name any store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
_READ = 1 << 20
LINES = "line long, value string, is_end boolean"
_ARROW = pa.schema([("line", pa.int64()), ("value", pa.string()), ("is_end", pa.bool_())])


def _store(path: str):
    """(file system, path inside it)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder by name; hidden and marker files are left out."""
    from pyarrow import fs

    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [i for i in store.get_file_info(fs.FileSelector(inner))
             if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")) and i.base_name.endswith(suffix)]
    return [(f"{path.rstrip('/')}/{i.base_name}", i.size) for i in sorted(found, key=lambda i: i.base_name)]


def _line_starts(path: str, lo: int, hi: int, size: int) -> int:
    """Lines that start at a byte of [lo, hi): behind every line feed, and at byte 0."""
    store, inner = _store(path)
    first, last = max(lo - 1, 0), min(hi, size) - 1
    n = 1 if lo == 0 and size else 0
    with store.open_input_file(inner) as f:
        f.seek(first)
        left = last - first
        while left > 0:
            block = f.read(min(left, _READ))
            n += block.count(b"\n")
            left -= len(block)
    return n


def _lines_of(path: str, lo: int, hi: int) -> Iterator[bytes]:
    """The lines that start in [lo, hi), without their line ends."""
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        at, rest = max(lo - 1, 0), b""
        f.seek(at)
        skip = lo > 0                       # up to the first line feed from lo - 1 on: the end of an earlier line
        while True:
            block = f.read(_READ)
            if not block:
                break
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for p in parts:
                if skip:
                    skip = False
                else:
                    if at >= hi:
                        return
                    yield p
                at += len(p) + 1
            if not skip and at >= hi:
                return
        if rest and not skip and at < hi:
            yield rest


@dataclass
class LineIndex:
    """Byte ranges ``(file, lo, hi, first line, lines)`` of the files in order."""

    path: str
    ranges: list[tuple[str, int, int, int, int]]

    @property
    def lines(self) -> int:
        return self.ranges[-1][3] + self.ranges[-1][4] if self.ranges else 0

    def touching(self, start: int, end: int) -> list[tuple[str, int, int, int, int]]:
        return [r for r in self.ranges if r[3] < end and r[3] + r[4] > start]

    def is_end(self, start: int, n: int) -> bool:
        """No line is left behind the lines [start, start + n)."""
        return start + n >= self.lines


def index_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> LineIndex:
    """First pass: count the line starts of all byte ranges, one range a task."""
    cuts = [(p, lo, min(lo + range_bytes, size), size) for p, size in _files(path) for lo in range(0, size, range_bytes)]
    if not cuts:
        return LineIndex(path, [])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pydict({"at": [r["at"] for r in rows],
                                              "n": [_line_starts(r["file"], r["lo"], r["hi"], r["size"]) for r in rows]},
                                             schema=pa.schema([("at", pa.int64()), ("n", pa.int64())]))

    table = spark.createDataFrame([(i, *c) for i, c in enumerate(cuts)], "at long, file string, lo long, hi long, size long")
    tasks = min(len(cuts), max(spark.sparkContext.defaultParallelism, len(cuts) // 16))
    found = dict(table.repartition(tasks, "at").mapInArrow(count, "at long, n long").toArrow().to_pydict().items())
    counts = dict(zip(found["at"], found["n"]))
    ranges, first = [], 0
    for i, (p, lo, hi, _) in enumerate(cuts):
        ranges.append((p, lo, hi, first, counts[i]))
        first += counts[i]
    return LineIndex(path, ranges)


class _Range(InputPartition):
    def __init__(self, file: str, lo: int, hi: int, first: int, start: int, end: int, last: int):
        self.file, self.lo, self.hi, self.first, self.start, self.end, self.last = file, lo, hi, first, start, end, last


def _read(part: _Range) -> Iterator[pa.RecordBatch]:
    line, held, size = part.first, [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()),
                                           pa.array([v.decode("utf-8", "replace").removesuffix("\r") for _, v in held], pa.string()),
                                           pa.array([n == part.last for n, _ in held])], schema=_ARROW)

    for value in _lines_of(part.file, part.lo, part.hi):
        if line >= part.end:
            break
        if line >= part.start:
            held.append((line, value))
            size += len(value)
        line += 1
        if size >= _READ or len(held) >= 10_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _LineReader(DataSourceReader):
    def __init__(self, options):
        self.start, self.end, self.last = (int(options[k]) for k in ("start", "end", "last"))
        self.ranges = json.loads(options["ranges"])

    def partitions(self) -> list[InputPartition]:
        return [_Range(f, lo, hi, first, self.start, self.end, self.last) for f, lo, hi, first, _ in self.ranges] or [
            _Range("", 0, 0, 0, 0, 0, -1)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read(partition) if partition.file else iter(())


class _LineStream(DataSourceStreamReader):
    def __init__(self, options):
        self.start, self.path = int(options["start"]), options["path"]
        self.range_bytes = int(options["range_bytes"])
        self.ranges = [tuple(r) for r in json.loads(options["ranges"])]
        self._drop_open_line()

    def _drop_open_line(self) -> None:
        """A last line without its end isn't there yet: leave its range to ``_extend``."""
        while self.ranges:
            f, lo, hi, first, n = self.ranges[-1]
            store, inner = _store(f)
            with store.open_input_file(inner) as g:
                g.seek(hi - 1)
                ended = g.read(1) == b"\n"
            if ended:
                return
            self.ranges.pop()

    def _extend(self) -> None:
        """Count what was appended behind the ranges known so far, up to the last line feed of each file."""
        known = {}
        for f, _, hi, _, _ in self.ranges:
            known[f] = hi
        first = self.ranges[-1][3] + self.ranges[-1][4] if self.ranges else 0
        newest = self.ranges[-1][0] if self.ranges else ""
        for f, size in _files(self.path):
            lo = known.get(f, 0)
            if f < newest or lo >= size:
                continue
            store, inner = _store(f)
            with store.open_input_file(inner) as g:
                g.seek(lo)
                while block := g.read(self.range_bytes):
                    while b"\n" not in block and (more := g.read(self.range_bytes)):
                        block += more
                    cut = block.rfind(b"\n") + 1
                    if not cut:
                        break
                    n = block.count(b"\n", 0, cut)
                    self.ranges.append((f, lo, lo + cut, first, n))
                    lo, first = lo + cut, first + n
                    g.seek(lo)

    def initialOffset(self) -> dict:
        return {"line": self.start}

    def latestOffset(self) -> dict:
        self._extend()
        return {"line": max(self.start, self.ranges[-1][3] + self.ranges[-1][4] if self.ranges else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = start["line"], end["line"]
        if not self.ranges or self.ranges[-1][3] + self.ranges[-1][4] < hi:
            self._extend()                  # a restarted query plans its open batch before it asks for the latest offset
        return [_Range(f, a, b, first, lo, hi, -1) for f, a, b, first, n in self.ranges if first < hi and first + n > lo]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class LineBatches(DataSource):
    """Spark data source ``line_batches``; built by ``read_lines`` and ``stream_lines``."""

    @classmethod
    def name(cls) -> str:
        return "line_batches"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LineReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _LineStream(self.options)


def read_lines(spark: SparkSession, index: LineIndex, start: int = 0, n: int | None = None) -> DataFrame:
    """``line, value, is_end`` of the lines [start, start + n) (from 0; to the end without ``n``)."""
    end = index.lines if n is None else min(start + n, index.lines)
    spark.dataSource.register(LineBatches)
    return (spark.read.format("line_batches").option("start", start).option("end", end).option("last", index.lines - 1)
            .option("ranges", json.dumps(index.touching(start, end))).load())


def stream_lines(spark: SparkSession, path: str, index: LineIndex | None = None, start: int = 0,
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same lines as a stream: everything from line ``start`` on, then what is appended.

    ``index`` spares the driver a scan of what is there already; ``is_end`` is false, as a stream has no end.
    """
    spark.dataSource.register(LineBatches)
    return (spark.readStream.format("line_batches").option("start", start).option("path", path)
            .option("range_bytes", range_bytes).option("ranges", json.dumps(index.ranges if index else [])).load())


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``line, is_end, record, bad``: the parsed record, or the raw text of a line that is no such record.

    Blank lines are left out (they keep their numbers).
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.where(F.length(F.trim("value")) > 0).select("line", "is_end", F.from_json(
        "value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record")
    record = F.when(bad.isNull(), F.struct(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]))
    return parsed.select("line", "is_end", record.alias("record"), bad.alias("bad"))


def load_jsonl_batch(spark: SparkSession, index: LineIndex, start: int, n: int,
                     schema: T.StructType) -> tuple[DataFrame, DataFrame, bool]:
    """SRC3: records of the lines [start, start + n) with their line, the bad lines with theirs, and whether that was the end.

    The next batch starts at ``start + n`` whether or not lines were bad, so a resumed run stays aligned with the file.
    """
    rows = parsed_lines(read_lines(spark, index, start, n), schema)
    good = rows.where("bad is null").select("line", "record.*")
    return good, rows.where("bad is not null").select("line", "bad"), index.is_end(start, n)
