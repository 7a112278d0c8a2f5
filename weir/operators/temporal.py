"""Operators over time-ordered rows: gaps, sessions, as-of and interval joins, overlaps, binning and rates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def gap(by: list[str], order: list[str], ts: str) -> Column:
    """Time since the row before."""
    return F.col(ts) - F.lag(ts).over(Window.partitionBy(*by).orderBy(*order))


def sessionize(df: DataFrame, by: list[str], order: list[str], ts: str, limit: int) -> DataFrame:
    """df with session: a new one wherever the gap reaches limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.coalesce((F.col(ts) - F.lag(ts).over(w) >= limit).cast("int"), F.lit(0))).withColumn("session", F.sum("_n").over(w)).drop("_n")


def asof(left: DataFrame, right: DataFrame, by: list[str], ts: str, value: str, direction: str = "backward", tie: str | None = None) -> DataFrame:
    """left with <value> of right's nearest row at or before (backward) or at or after (forward) its ts.

    Both sides are laid end to end and the last value is carried along a window, one shuffle by key; equal times match.
    """
    cols = left.columns
    a = left.select(F.struct(*cols).alias("_row"), *by, ts, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1 if direction == "backward" else 0).alias("_side"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *by, ts, F.col(value).alias("_v"), F.lit(0 if direction == "backward" else 1).alias("_side"))
    order = [ts, "_side"] if direction == "backward" else [F.col(ts).desc(), F.col("_side").desc()]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("_m", F.last("_v", ignorenulls=True).over(w)).where("_row is not null").select(*(F.col(f"_row.{c}").alias(c) for c in cols), F.col("_m").alias(f"asof_{value}"))


def point_in_interval(points: DataFrame, spans: DataFrame, by: list[str], ts: str, lo: str, hi: str, width: int) -> DataFrame:
    """Inner join of points with spans [lo, hi) of the same key: spans are dealt to time buckets of width, so Spark hashes instead of looping."""
    p = points.withColumn("_b", F.floor(F.col(ts) / width))
    s = spans.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    return p.join(s, [*by, "_b"]).where((F.col(ts) >= F.col(lo)) & (F.col(ts) < F.col(hi))).drop("_b")


def overlap(a: DataFrame, b: DataFrame, by: list[str], width: int) -> DataFrame:
    """a (id, lo, hi, by) with overlap: time that spans of b (blo, bhi) of the same key share with it, 0 without any."""
    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.where(F.col(hi) > F.col(lo)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    x, y = dealt(a, "lo", "hi"), dealt(b, "blo", "bhi")
    start = F.greatest("lo", "blo")
    # A pair that shares several buckets counts in the first of them only.
    both = x.join(y, [*by, "_b"]).where((F.least("hi", "bhi") > start) & (F.col("_b") == F.floor(start / width)))
    total = both.groupBy("id").agg(F.sum(F.least("hi", "bhi") - start).alias("overlap"))
    return a.join(total, "id", "left").na.fill(0, ["overlap"])


def dominant_holder(a: DataFrame, b: DataFrame, by: list[str], width: int, score: Column | None = None) -> DataFrame:
    """(id, holder) of each span of a (id, lo, hi, by) that any of b (holder, blo, bhi) meets, that is, starts before its end and ends after its start: the holder of the highest score (long) in t, the time shared (default: t), ties to the smaller holder.

    Spans without length, or that end before they start, meet those around them too: t is then 0 or less.
    """
    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.least(lo, hi) / width), F.floor(F.greatest(F.col(lo), F.col(hi) - 1) / width))))

    o = dealt(a, "lo", "hi").join(dealt(b, "blo", "bhi"), [*by, "_b"]).where("bhi > lo and blo < hi").withColumn("t", F.least("hi", "bhi") - F.greatest("lo", "blo"))
    # A pair that shares several buckets counts in the first of them only.
    o = o.where(F.col("_b") == F.floor(F.greatest(F.least("lo", "hi"), F.least("blo", "bhi")) / width))
    # Score, then smaller holder, as one whole number: Spark aggregates by it in a hash table, by a struct only after a sort of all pairs.
    best = (F.col("t") if score is None else score).cast("decimal(19, 0)") * F.lit(Decimal(10**19)) - F.col("holder").cast("decimal(19, 0)")
    return o.groupBy("id").agg(F.max_by("holder", best).alias("holder"))


def moving_mean(by: list[str], order: list[str], value: str, back: int, ahead: int = 0) -> Column:
    """Mean of the rows from back before to ahead after; at the ends, of those that there are."""
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-back, ahead))


def binned(df: DataFrame, ts: str, bins: int) -> DataFrame:
    """(bin, n) of equal time bins over the whole span, late rows in the last one, empty bins included."""
    ends = df.agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"))
    width = F.greatest(F.expr(f"(t1 - t0) div {bins}"), F.lit(1))
    counts = df.select(ts).join(F.broadcast(ends)).groupBy(F.least(F.floor((F.col(ts) - F.col("t0")) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate(by: list[str], order: list[str], counter: str, ts: str) -> Column:
    """Change of a counter a second (ts in microseconds); a counter that fell counts as 0; null on the first row."""
    w = Window.partitionBy(*by).orderBy(*order)
    dt = F.col(ts) - F.lag(ts).over(w)
    return F.when(dt > 0, F.greatest(F.col(counter) - F.lag(counter).over(w), F.lit(0.0)) * 1e6 / dt)
