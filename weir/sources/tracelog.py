"""Trace logs of any size as a data source: one log is read by many tasks, each in bounded pieces.

Records have their length before them and no marks between them, so where one begins is known only from those before.
A first pass walks each log from length to length, without reading what lies between, and writes down where a record
begins about every so many bytes, with its ordinal: the index. The source makes a partition of each entry, and a task
turns its stretch of the log into columns, a few megabytes at a time.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weir.session import settle
from weir.sources.trace import HEADER, LARGEST, LAYOUTS, MAGIC, SCHEMA, VERSION, _columns

#: Bytes of a split, of a piece that a task holds, and of one read while a log is walked.
SPLIT, PIECE, STEP = 128 << 20, 8 << 20, 1 << 16
INDEX = "file string, start long, end long, seq long"
HEADERS = "file string, version int, flags int, mono long, real long, pattern string"
_LEAST = {k: struct.calcsize(f) for k, (f, _) in LAYOUTS.items()}


def _open(uri: str):
    """The file of a URI as Spark writes it (file:/x too), for reading at any place."""
    fs, path = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return fs.open_input_file(path)


def _header(f) -> tuple:
    head = f.read_at(HEADER.size, 0)
    if len(head) < HEADER.size or head[:8] != MAGIC or struct.unpack_from("<I", head, 8)[0] != VERSION:
        raise ValueError("not a trace log")
    return HEADER.unpack(head)


def walk(f, split: int = SPLIT) -> Iterator[tuple[int, int, int]]:
    """(start, end, seq) of stretches of split bytes or little more, whole records each. A cut or corrupt tail ends the log; a log without records has none."""
    size, at, seq, length = f.size(), HEADER.size, 0, struct.Struct("<I").unpack_from
    start, first = at, 0
    held, base = b"", at
    while at + 4 <= size:
        if not base <= at <= base + len(held) - 4:
            held, base = f.read_at(min(STEP, size - at), at), at
        n = length(held, at - base)[0]
        if n < 4 or n > LARGEST or at + 4 + n > size:
            break
        at, seq = at + 4 + n, seq + 1
        if at - start >= split:
            yield start, at, first
            start, first = at, seq
    if at > start:
        yield start, at, first


def _index(batches: Iterator[pa.RecordBatch], split: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path) as f:
                _header(f)
                rows = [(path, *x) for x in walk(f, split)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "start", "end", "seq"])


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open(path) as f:
                _, version, flags, mono, real, pattern = _header(f)
            row = (path, version, flags, mono, real, pattern.split(b"\0", 1)[0].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], [c.split()[0] for c in HEADERS.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the logs under path, a task each; their content is not read."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.repartition(max(1, min(files.count(), 10_000)))


def index_traces(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(file, start, end, seq): the stretches of each log under path, as a table in the shared folder. A file that is no log is an error."""
    return settle(_files(spark, path).mapInArrow(partial(_index, split=split), INDEX), "index")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, version, flags, mono, real, pattern) of each log: mono and real are one moment by either clock, which wall_clock() takes."""
    return _files(spark, path).mapInArrow(_headers, HEADERS)


class Stretch(InputPartition):
    def __init__(self, file: str, start: int, end: int, seq: int):
        super().__init__(file)
        self.file, self.start, self.end, self.seq = file, start, end, seq


def _marks(buffer: bytes, seq: int, types: frozenset[int] | None) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """(type, start, size, seq) of the known records that buffer holds whole, where the next one begins, and its ordinal."""
    pair, at, out = struct.Struct("<2I").unpack_from, 0, []
    while at + 8 <= len(buffer):
        n, kind = pair(buffer, at)
        if at + 4 + n > len(buffer):
            break
        if n >= _LEAST.get(kind, LARGEST + 1) and (types is None or kind in types):
            out.append((kind, at + 4, n, seq))
        at, seq = at + 4 + n, seq + 1
    return out, at, seq


class TraceReader(DataSourceReader):
    def __init__(self, options):
        self.index, self.types = options.get("index"), options.get("types")
        if not self.index:
            raise ValueError("trace_log needs the option index: the path of a table made by index_traces")
        self.types = frozenset(int(t) for t in self.types.split(",")) if self.types else None

    def partitions(self) -> list[Stretch]:
        """One for each row of the index, which has a few dozen bytes for SPLIT bytes of a log."""
        fs, path = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", self.index))
        rows = ds.dataset(path, format="parquet", filesystem=fs).to_table().to_pylist()
        return [Stretch(**r) for r in rows] or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        at, seq = partition.start, partition.seq
        with _open(partition.file) as f:
            while at < partition.end:
                buffer = f.read_at(min(PIECE, partition.end - at), at)
                marks, used, seq = _marks(buffer, seq, self.types)
                if not used:
                    raise ValueError(f"{partition.file} has changed since it was indexed")
                at += used
                if marks:
                    m, data = np.array(marks, np.int64), np.frombuffer(buffer, np.uint8)
                    parts = [_columns(int(k), data, *(m[m[:, 0] == k][:, c] for c in (1, 2, 3)), partition.file) for k in np.unique(m[:, 0])]
                    yield from pa.concat_tables(parts).sort_by("seq").combine_chunks().to_batches()


class TraceLog(DataSource):
    """spark.read.format("trace_log").option("index", path of the table of index_traces), and option("types", "6,7") for these types of record alone."""

    @classmethod
    def name(cls) -> str:
        return "trace_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TraceReader:
        return TraceReader(self.options)


def read_trace_splits(spark: SparkSession, path: str, types: tuple[int, ...] = (), split: int = SPLIT) -> DataFrame:
    """All records of the logs under path (those of types alone where some are given), as read_traces gives them, a task a stretch of split bytes.

    seq is a record's ordinal in its log however it is split. Unknown and short records are left out and counted in
    seq; a cut or corrupt tail ends a log; logs grow no further once indexed. Needs a file system that Arrow reaches
    (file, hdfs, s3, gs); read_traces has none of these needs, and the limit of Spark's binary files (2 GB).
    """
    spark.dataSource.register(TraceLog)
    source = spark.read.format("trace_log").option("index", index_traces(spark, path, split).settled_at)
    return (source.option("types", ",".join(map(str, types))) if types else source).load()
