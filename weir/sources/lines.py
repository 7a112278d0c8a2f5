"""Line and value streams from text files, with their order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.text import field, number


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = content.as_py()
            binary = b"\0" in data[:32768]
            lines = data.decode("utf-8", "replace").split("\n")
            if lines and lines[-1] == "":
                lines.pop()
            for a in range(0, len(lines), 10_000):
                part = lines[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(a + 1, a + len(part) + 1), pa.int64()), pa.array(part), pa.array([binary] * len(part))], ["src", "line_no", "line", "is_binary"])


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(src, line_no, line, is_binary): lines end at \\n alone; a file with a NUL near its head counts as binary."""
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_number, "src string, line_no long, line string, is_binary boolean")


def read_unordered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(src, line) for operators that need no order: large files are split over tasks."""
    return spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("src"), F.col("value").alias("line"))


def values(lines: DataFrame, n: int | None = None, delim: str = " \t") -> DataFrame:
    """lines with v, the number in the whole line or its n-th field, null where there is none (count those for a warning)."""
    return lines.withColumn("v", number(F.col("line") if n is None else field(F.col("line"), n, delim)))
