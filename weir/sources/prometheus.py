"""Prometheus text archives as rows, and their reduction to series, cells and samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, line_no long, name string, labels map<string,string>, value double, type string"
_SAMPLE = re.compile(r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{((?:[^"}]|"(?:\\.|[^"\\])*")*)\})?\s+(\S+)')
_LABEL = re.compile(r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"')


def parse_line(line: str):
    """(name, labels, value) or None; quotes in labels may hold braces, commas and escapes."""
    m = _SAMPLE.match(line)
    if not m:
        return None
    try:
        value = float(m[3])
    except ValueError:
        return None
    return m[1], {k: re.sub(r"\\(.)", lambda e: {"n": "\n"}.get(e[1], e[1]), v) for k, v in _LABEL.findall(m[2] or "")}, value


def samples_of(text: str) -> Iterator[tuple[int, str, dict[str, str], float, str | None]]:
    """(line_no, name, labels, value, type) of each sample; comments, blank and garbled lines are passed over."""
    types: dict[str, str] = {}
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip(" \t\r")
        if line.startswith("# TYPE "):
            _, _, name, kind = (line.split(None, 3) + [""])[:4]
            types[name] = kind
        elif line and line[0] != "#" and (s := parse_line(line)):
            yield n, *s, types.get(s[0]) or types.get(re.sub(r"_(?:bucket|sum|count)$", "", s[0]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows += [(file, n, name, list(labels.items()), value, kind) for n, name, labels, value, kind in samples_of(content.decode("utf-8", "replace"))]
        cols = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["file", "line_no", "name", "labels", "value", "type"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The samples of all *.prom files under path but analysis-*; a file, which holds one scrape log, is a row of one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.prom").option("recursiveFileLookup", "true").load(path)
    return files.where("not element_at(split(path, '/'), -1) like 'analysis-%'").select("path", "content").mapInArrow(_parse, SCHEMA)


def series(samples: DataFrame) -> DataFrame:
    """last, mean, max, min and number of samples of each series of each file."""
    key = F.to_json(F.array_sort(F.map_entries("labels"))).alias("label_key")
    return samples.groupBy("file", "name", key).agg(F.first("labels").alias("labels"), F.max_by("value", "line_no").alias("last"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.count("*").alias("samples"))


def with_run(samples: DataFrame, groups: dict[str, str] | None = None) -> DataFrame:
    """samples with capture (from the file's name), version and commit, and group.

    version and commit are those of the last *_info sample of the file before a sample; one that comes before any has
    none. groups names files by a part of their path: the longest that a path contains counts.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    info = F.last(F.when(F.col("name").like("%_info"), F.col("labels")), ignorenulls=True).over(upto)
    out = samples.withColumn("_i", info).where("name not like '%_info'")
    group = F.lit(None).cast("string")
    for name, part in sorted((groups or {}).items(), key=lambda g: len(g[1])):
        group = F.when(F.contains("file", F.lit(part)), name).otherwise(group)
    return out.select(*samples.columns, F.col("_i")["version"].alias("version"), F.col("_i")["git_commit"].alias("commit"), F.regexp_extract("file", r"(\d{8}-\d{6})", 1).alias("capture"), group.alias("group"))


def rename(samples: DataFrame, families: dict[str, str], labels: dict[str, str] | None = None) -> DataFrame:
    """samples with families and names of labels under their aliases; a label whose alias is there already keeps its own name."""
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    out = samples.withColumn("name", F.coalesce(table(families)[F.col("name")], F.col("name"))) if families else samples
    if labels:
        known = table(labels)
        out = out.withColumn("labels", F.transform_keys("labels", lambda k, v: F.when(known[k].isNotNull() & ~F.array_contains(F.map_keys("labels"), known[k]), known[k]).otherwise(k)))
    return out


def choose(samples: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """samples of families that contain include, and not exclude."""
    keep = F.lit(True) if include is None else F.contains("name", F.lit(include))
    return samples.where(keep if exclude is None else keep & ~F.contains("name", F.lit(exclude)))


def cells(samples: DataFrame, axis: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(metric, cell, axis, value) with a cell's labels less the axis, le, capture and those dropped."""
    gone = {axis, "le", "capture", *drop} | ({"commit"} if axis == "version" else {"version"} if axis == "commit" else set())
    kept = F.map_filter("labels", lambda k, v: ~k.isin(*gone))
    at = F.col(axis) if axis in ("version", "commit", "capture", "group") else F.col("labels")[axis]
    return samples.where("not name like '%_bucket'").select(F.col("name").alias("metric"), F.to_json(F.array_sort(F.map_entries(kept))).alias("cell"), at.alias("axis"), "value").where("axis is not null")


def histogram_samples(samples: DataFrame) -> DataFrame:
    """(file, name, midpoint, n): cumulative buckets taken apart, each at the geometric middle of its bounds; +Inf at its lower bound."""
    from pyspark.sql import Window

    b = samples.where("name like '%_bucket'").withColumn("le", F.when(F.col("labels")["le"] == "+Inf", float("inf")).otherwise(F.col("labels")["le"].try_cast("double")))
    rest = F.to_json(F.array_sort(F.map_entries(F.map_filter("labels", lambda k, v: k != "le"))))
    w = Window.partitionBy("file", "name", rest).orderBy("le")
    b = b.withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("n", F.greatest(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), F.lit(0.0)).cast("long"))
    mid = F.when(F.col("le") == float("inf"), F.col("lo")).when(F.col("lo") > 0, F.sqrt(F.col("lo") * F.col("le"))).otherwise(F.col("le") / 2)
    return b.where("n > 0").select("file", "name", mid.alias("midpoint"), "n")


def histogram_cells(samples: DataFrame, axis: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(metric, cell, axis, midpoint, n): a histogram family's samples rebuilt from its buckets, with the cell that cells() would give them."""
    from pyspark.sql import Window

    gone = {axis, "le", "capture", *drop} | ({"commit"} if axis == "version" else {"version"} if axis == "commit" else set())
    at = F.col(axis) if axis in ("version", "commit", "capture", "group") else F.col("labels")[axis]
    entries = lambda keep: F.to_json(F.array_sort(F.map_entries(F.map_filter("labels", keep))))
    le = F.when(F.col("labels")["le"] == "+Inf", float("inf")).otherwise(F.col("labels")["le"].try_cast("double"))
    rows = samples.where("name like '%_bucket'").select("file", F.regexp_replace("name", "_bucket$", "").alias("metric"), entries(lambda k, v: k != "le").alias("_own"), entries(lambda k, v: ~k.isin(*gone)).alias("cell"), at.alias("axis"), le.alias("le"), "value")
    w = Window.partitionBy("file", "metric", "_own").orderBy("le")
    rows = rows.where("axis is not null").withColumn("lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("n", F.greatest(F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)), F.lit(0.0)).cast("long"))
    mid = F.when(F.col("le") == float("inf"), F.col("lo")).when(F.col("lo") > 0, F.sqrt(F.col("lo") * F.col("le"))).otherwise(F.col("le") / 2)
    return rows.where("n > 0").select("metric", "cell", "axis", mid.alias("midpoint"), "n")


def longest_prefix(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(metric, prefix) of each name of names (metric) that begins with one of prefixes (metric), an underscore and more: the longest.

    A name is dealt to its own beginnings at underscores, so the join is by equality.
    """
    parts = F.split("metric", "_")
    begin = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    dealt = names.select("metric").distinct().where(F.size(parts) > 1).select("metric", F.explode(begin).alias("prefix")).where("length(metric) > length(prefix) + 1 and prefix <> ''")
    return dealt.join(prefixes.select(F.col("metric").alias("prefix")).distinct(), "prefix").groupBy("metric").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))


def backed_by_histograms(gauges: DataFrame, histograms: DataFrame) -> DataFrame:
    """(metric, cell, axis, midpoint, n): of each gauge family's cells (metric, cell, axis) the samples of the histogram family that its name extends, of the same cell and place."""
    of = longest_prefix(gauges, histograms)
    cells_ = gauges.select("metric", "cell", "axis").distinct().join(of, "metric")
    return cells_.join(histograms.withColumnRenamed("metric", "prefix"), ["prefix", "cell", "axis"]).select("metric", "cell", "axis", "midpoint", "n")


def version_key(v: str) -> tuple:
    """Natural order of versions: numbers by value, a prerelease before its release, a leading v ignored."""
    parts = re.findall(r"\d+|[A-Za-z]+", v.lstrip("vV"))
    return (*((1, int(p), "") if p.isdigit() else (-1, 0, p) for p in parts), (0, 0, ""))
