"""Windows over long sequences whose neighbours lie in other tasks: chunks of bounded size with what follows them.

A sequence, also a single one that holds all rows, is numbered without gathering it anywhere: rows are dealt by ranges
of (key, order), numbered inside their range, and moved up by how many rows of their key the ranges before hold. Rows
are then dealt to chunks of a few thousand; a chunk also gets the rows after it that its last windows reach into.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.functions.disorder import classify
from weir.session import bound_batches, settle

#: Positions of a chunk, at least.
CHUNK = 16_384


def numbered(df: DataFrame, order: list[str], by: list[str], parts: int | None = None) -> DataFrame:
    """df with n, the place from 0 of a row among those of its key in that order; rows that tie in it are placed either way."""
    cut = [*by, *order]
    dealt = df.repartitionByRange(parts, *cut) if parts else df.repartitionByRange(*cut)
    dealt = settle(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    # As many rows as there are keys, and ranges.
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    on = F.col("a._range") == F.col("b._range")
    for c in by:
        on &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    rows = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1).alias("a").join(counts.alias("b"), on)
    return rows.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("b._before") + F.col("a._at")).alias("n"))


def chunked(rows: DataFrame, window: int, stride: int) -> tuple[DataFrame, int]:
    """rows (with n) under each _chunk that needs them, and the size of chunks: a chunk's windows begin in it; the rows after it that they reach are its halo."""
    size = stride * max(1, -(-CHUNK // stride))
    first = F.greatest(F.lit(0), F.floor((F.col("n") - (window - 1)) / size)).cast("long")
    return rows.withColumn("_chunk", F.explode(F.sequence(first, F.floor(F.col("n") / size).cast("long")))), size


def profile(df: DataFrame, value: str, order: list[str], by: list[str], window: int = 512, stride: int | None = None, parts: int | None = None) -> DataFrame:
    """(by, start, len, cls, inversion, distinct) of each whole window of each key's values, begun every stride places (a window by default).

    Rows without a value are left out before rows are numbered. A key with fewer rows than a window has none.
    """
    if window < 1 or (stride is not None and stride < 1):
        raise ValueError("window and stride are 1 at least")
    stride = stride or window
    rows = numbered(df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v")), order, by, parts)
    cut, size = chunked(rows.select(*by, "n", "_v"), window, stride)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema)
    names = ["start", "len", "cls", "inversion", "distinct"]

    def each(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        n, v = g["n"].to_numpy(), g["_v"].to_numpy(float)
        lo = int(k[-1]) * size
        begin = max(lo, int(n[0]))
        found = []
        for a in range(begin + -begin % stride, min(lo + size, int(n[-1]) - window + 2), stride):
            p = classify(v[a - int(n[0]) : a - int(n[0]) + window])
            found.append((a, window, p["cls"], p["inversion"], p["distinct"]))
        out = pd.DataFrame(found, columns=names)
        for i, c in reversed(list(enumerate(by))):
            out.insert(0, c, pd.Series([k[i]] * len(out), dtype=g[c].dtype))
        return out

    return cut.groupBy(*by, "_chunk").applyInPandas(each, (keys + ", " if keys else "") + "start long, len long, cls string, inversion double, distinct long")


def locate(df: DataFrame, value: str, order: list[str], by: list[str], cls: str, window: int = 512, stride: int | None = None, parts: int | None = None) -> DataFrame:
    """The windows of profile() that are of the class."""
    return profile(df, value, order, by, window, stride, parts).where(F.col("cls") == cls)


def locate_values(df: DataFrame, value: str, order: list[str], by: list[str], cls: str, window: int = 512, stride: int | None = None, parts: int | None = None) -> DataFrame:
    """df's rows with n, each once, that a window of the class covers.

    Rows and windows meet by chunk, a window in each chunk that it touches; inside one a search among the starts decides.
    """
    size = CHUNK
    rows = numbered(df.where(F.col(value).isNotNull()), order, by, parts).withColumn("_chunk", F.floor(F.col("n") / size).cast("long"))
    hits = locate(df, value, order, by, cls, window, stride, parts).select(*by, "start")
    hits = hits.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("start") / size).cast("long"), F.floor((F.col("start") + window - 1) / size).cast("long"))))

    def each(r: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(h):
            return r.iloc[:0].drop(columns="_chunk")
        starts, n = np.sort(h["start"].to_numpy()), r["n"].to_numpy()
        last = np.searchsorted(starts, n, "right") - 1
        return r[(last >= 0) & (n < starts[np.maximum(last, 0)] + window)].drop(columns="_chunk")

    return rows.groupBy(*by, "_chunk").cogroup(hits.groupBy(*by, "_chunk")).applyInPandas(each, rows.drop("_chunk").schema)


#: Windows of a block, and of a tile of a product of two blocks.
BLOCK, TILE = 32_768, 1024


def _unit(v: np.ndarray, m: int) -> np.ndarray:
    """The windows of v, each with mean 0 and deviation 1 (0 where it is constant)."""
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    sd = w.std(axis=1, keepdims=True)
    return np.where(sd > 1e-12, (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), 0)


def _nearest(a: np.ndarray, b: np.ndarray, lo: int, up: int, m: int, skip: int) -> tuple[np.ndarray, ...]:
    """Of two stretches of values, the windows of which begin at lo and up: squared distance to and place of the nearest of the other stretch's windows, for either; those within skip are left out."""
    ka, kb = len(a) - m + 1, len(b) - m + 1
    best = [np.full(ka, np.inf), np.full(kb, np.inf)]
    at = [np.full(ka, -1, np.int64), np.full(kb, -1, np.int64)]
    for i in range(0, ka, TILE):
        x = _unit(a[i : min(i + TILE, ka) + m - 1], m)
        for j in range(0, kb, TILE):
            y = _unit(b[j : min(j + TILE, kb) + m - 1], m)
            d = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)
            rows, cols = lo + i + np.arange(len(x)), up + j + np.arange(len(y))
            d[np.abs(rows[:, None] - cols[None, :]) <= skip] = np.inf
            for side, axis, first, other, k in ((0, 1, i, up + j, len(x)), (1, 0, j, lo + i, len(y))):
                near = d.argmin(axis=axis)
                found = d.min(axis=axis)
                s = slice(first, first + k)
                closer = found < best[side][s]
                best[side][s] = np.where(closer, found, best[side][s])
                at[side][s] = np.where(closer, other + near, at[side][s])
    return best[0], at[0], best[1], at[1]


def matrix_profile(df: DataFrame, value: str, order: list[str], by: list[str], m: int, skip: int | None = None, parts: int | None = None) -> DataFrame:
    """(by, start, distance, nearest) of each window of m values of a key: the z-normalised window closest to it that begins more than skip (m / 4) places away.

    Windows are dealt to blocks; each pair of a key's blocks is one product of a task, which holds two blocks and gives
    each window its nearest in the other; the least of these counts, at equal distance the one that begins first. A
    window without such a neighbour has no row, a constant window is as far from any other as the square root of m.
    """
    skip = max(1, m // 4) if skip is None else skip
    rows = numbered(df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v")), order, by, parts).select(*by, "n", "_v")
    first = F.greatest(F.lit(0), F.floor((F.col("n") - (m - 1)) / BLOCK)).cast("long")
    dealt = rows.withColumn("_b", F.explode(F.sequence(first, F.floor(F.col("n") / BLOCK).cast("long"))))
    blocks = dealt.groupBy(*by, "_b").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "_v"))), lambda x: x["_v"]).alias("v")).where(F.size("v") >= m)
    blocks = settle(blocks, "blocks")
    last = blocks.groupBy(*by).agg(F.max("_b").alias("_last"))
    null_safe = F.lit(True)
    for c in by:
        null_safe &= F.col(f"a.{c}").eqNullSafe(F.col(f"l.{c}"))
    counted = blocks.alias("a").join(last.alias("l"), null_safe).select("a.*", "_last")
    lower = counted.select(*by, F.col("_b").alias("_i"), F.explode(F.sequence("_b", "_last")).alias("_j"), F.col("v").alias("_a")).alias("a")
    upper = counted.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), F.col("v").alias("_c")).alias("l")
    pairs = lower.join(upper, null_safe & (F.col("a._i") == F.col("l._i")) & (F.col("a._j") == F.col("l._j"))).select(*(F.col(f"a.{c}") for c in by), "a._i", "a._j", "_a", "_c")
    keys = pairs.select(*by).schema
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keys) + "start long, square double, nearest long"

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = batch.column("_i")[k].as_py(), batch.column("_j")[k].as_py()
                a, c = (np.asarray(batch.column(x)[k].values, float) for x in ("_a", "_c"))
                found = _nearest(a, c, i * BLOCK, j * BLOCK, m, skip)
                for start, square, at in ((i * BLOCK, *found[:2]), (j * BLOCK, *found[2:])):
                    ok = at >= 0
                    own = [pa.array([batch.column(x)[k].as_py()] * int(ok.sum()), batch.column(x).type) for x in by]
                    yield pa.RecordBatch.from_arrays([*own, pa.array((start + np.arange(len(at)))[ok]), pa.array(square[ok]), pa.array(at[ok])], [*by, "start", "square", "nearest"])

    bound_batches(df.sparkSession)
    found = pairs.repartition(*by, "_i", "_j").mapInArrow(each, schema)
    near = found.groupBy(*by, "start").agg(F.min(F.struct("square", "nearest")).alias("_n"))
    return near.select(*by, "start", F.sqrt("_n.square").alias("distance"), F.col("_n.nearest").alias("nearest"))
