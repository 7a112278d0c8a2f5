"""Stream operators over rows that carry their order: selection, grouping, joins, sets, runs and order statistics.

Order is a column (or several) named by the caller; nothing relies on the order in which Spark holds rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

TEXT_OPS = ("first", "last", "mode", "antimode", "unique", "collapse", "countunique")


def group(df: DataFrame, key: str, op: str, value: str | None = None, order: str | None = None) -> DataFrame:
    """(key, value, first): one aggregate by key, first being the smallest order of its rows for output in first-seen order.

    Numeric operations skip null values; the sample deviation of one value is NaN, the population's 0. mode and
    antimode break ties by the smaller value. Partial aggregates run before the shuffle; mode and antimode count
    (key, value) pairs first, so a hot key is spread over its values.
    """
    first = F.min(order).alias("first") if order else F.lit(None).cast("long").alias("first")
    df = df.where(F.col(key).isNotNull())
    if op in ("mode", "antimode"):
        counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), *([F.min(order).alias("o")] if order else []))
        want = F.struct((-F.col("n") if op == "mode" else F.col("n")).alias("n"), F.col(value).alias("v"))
        return counts.groupBy(key).agg(F.min(want)["v"].alias("value"), (F.min("o") if order else F.lit(None).cast("long")).alias("first"))
    if op == "median":
        firsts = df.groupBy(key).agg(first)
        return firsts.join(medians_by(df, [key], value, "value"), key, "left").select(key, "value", "first")
    v = F.col(value) if value else None
    agg: Column = {
        "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "count": lambda: F.count("*"), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "sstdev": lambda: F.when(F.count(v) == 1, F.lit(float("nan"))).otherwise(F.stddev_samp(v)), "pstdev": lambda: F.stddev_pop(v),
        "first": lambda: F.min_by(v, order), "last": lambda: F.max_by(v, order),
        "unique": lambda: F.array_join(F.array_sort(F.collect_set(v.cast("string"))), ","),
        "collapse": lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), v.cast("string").alias("v")))), lambda x: x["v"]), ","),
        "countunique": lambda: F.count_distinct(v),
    }[op]()
    return df.groupBy(key).agg(agg.alias("value"), first)


def join_first(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join in which only the right side's first row by order counts for each key."""
    rest = [c for c in right.columns if c != key]
    once = right.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))
    return left.join(once, key)


def intersect(left: DataFrame, right: DataFrame, line: str, order: str) -> DataFrame:
    """Distinct lines of left that right has, with the smallest order of each."""
    return left.join(right.select(line).distinct(), line, "left_semi").groupBy(line).agg(F.min(order).alias(order))


def subtract(left: DataFrame, right: DataFrame, line: str, order: str) -> DataFrame:
    return left.join(right.select(line).distinct(), line, "left_anti").groupBy(line).agg(F.min(order).alias(order))


def union(left: DataFrame, right: DataFrame, line: str, order: str) -> DataFrame:
    """Distinct lines of both; side 0 for those of left, whose order they keep, side 1 for the rest."""
    both = left.select(line, F.lit(0).alias("side"), F.col(order)).union(right.select(line, F.lit(1), F.col(order)))
    return both.groupBy(line).agg(F.min(F.struct("side", order)).alias("m")).select(line, "m.side", F.col(f"m.{order}"))


def comm(left: DataFrame, right: DataFrame, line: str) -> DataFrame:
    """(line, only_left, only_right, both): how often each line pairs up, as the three columns of a merge of sorted streams."""
    counts = left.groupBy(line).agg(F.count("*").alias("l")).join(right.groupBy(line).agg(F.count("*").alias("r")), line, "full")
    counts = counts.na.fill(0, ["l", "r"])
    return counts.select(line, F.greatest(F.col("l") - F.col("r"), F.lit(0)).alias("only_left"), F.greatest(F.col("r") - F.col("l"), F.lit(0)).alias("only_right"), F.least("l", "r").alias("both"))


def paste(left: DataFrame, right: DataFrame, order: str, sep: str = "\t") -> DataFrame:
    """Lines side by side by order; the shorter side is padded with nothing."""
    a, b = left.select(order, F.col("line").alias("a")), right.select(order, F.col("line").alias("b"))
    return a.join(b, order, "full").select(order, F.concat(F.coalesce("a", F.lit("")), F.lit(sep), F.coalesce("b", F.lit(""))).alias("line"))


def runs(df: DataFrame, value: str, order: list[str], by: list[str]) -> DataFrame:
    """df with run: the number of changes of value so far in its partition, so equal neighbours share it."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    change = F.when(F.row_number().over(w) == 1, 0).otherwise(change)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def uniq(df: DataFrame, value: str, order: list[str], by: list[str], keep: str = "all") -> DataFrame:
    """(by, run, value, n) of runs of equal neighbours; keep: all, repeated (n > 1) or single (n = 1)."""
    out = runs(df, value, order, by).groupBy(*by, "run").agg(F.min_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))
    return {"all": out, "repeated": out.where("n > 1"), "single": out.where("n = 1")}[keep]


def context(df: DataFrame, hit: Column, order: list[str], by: list[str], before: int, after: int) -> DataFrame:
    """Rows within before rows ahead of, or after rows behind, a hit; is_hit tells hits from context."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("is_hit", hit).withColumn("_near", F.max(F.col("is_hit").cast("int")).over(w.rowsBetween(-after, before))).where("_near = 1").drop("_near")


def context_groups(df: DataFrame, hit: Column, order: list[str], by: list[str], before: int, after: int) -> DataFrame:
    """The rows of context with what = line, and before each group that does not follow on from the last one a row with what = --."""
    w = Window.partitionBy(*by).orderBy(*order)
    near = context(df.withColumn("_i", F.row_number().over(w)), hit, order, by, before, after)
    cut = F.coalesce(F.col("_i") - F.lag("_i").over(w) > 1, F.lit(False))
    return near.withColumn("_cut", cut).withColumn("what", F.explode(F.when(F.col("_cut"), F.array(F.lit("--"), F.lit("line"))).otherwise(F.array(F.lit("line"))))).drop("_i", "_cut")


def first_n_by(df: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    """The first n rows of each group, the most that leave a task before the shuffle (a ranking limit in the plan)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def order_statistics(df: DataFrame, value: str, ranks: list[int], n: int) -> DataFrame:
    """(rank, value): exact order statistics from 0, without a global sort; n is the number of values that are not null.

    A sketch brackets all ranks at once (rank error below n / 10,000), a second pass counts what lies below and inside
    each bracket; then only values inside, a few ten-thousandths of all, are counted by value and put in order.
    """
    spark = df.sparkSession
    ranks = sorted(set(ranks))
    if not ranks or n <= 0:
        return spark.createDataFrame([], "rank long, value double")
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    qs = [min(max((k + 0.5) / n + e, 0.0), 1.0) for k in ranks for e in (-3e-4, 3e-4)]
    cuts = v.agg(F.percentile_approx("v", qs, 10_000)).first()[0]
    pairs = list(zip(cuts[::2], cuts[1::2]))
    least, most, *counts = v.agg(F.min("v"), F.max("v"), *(x for a, b in pairs for x in (F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)))).first()
    brackets = []
    for k, (a, b), below, upto in zip(ranks, pairs, counts[::2], counts[1::2]):
        a, below = (a, below) if below <= k else (least, 0)  # where the sketch missed, the whole range on that side
        brackets.append(F.struct(F.lit(k).cast("long").alias("rank"), F.lit(float(a)).alias("a"), F.lit(float(b if upto > k else most)).alias("b"), F.lit(below).cast("long").alias("below")))
    held = F.filter(F.array(*brackets), lambda x: (F.col("v") >= x["a"]) & (F.col("v") <= x["b"]))
    inside = v.select("v", F.explode(held).alias("x")).groupBy("x.rank", "x.below", "v").agg(F.count("*").alias("k"))
    upto = F.col("below") + F.sum("k").over(Window.partitionBy("rank").orderBy("v"))
    return inside.withColumn("upto", upto).where("upto > rank").groupBy("rank").agg(F.min("v").alias("value"))


def ranked_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, v, k, upto, n): how often each value occurs in its group, how many values there are up to it and in all. Groups are not null.

    Values are counted first; ranks come from totals of logarithmic buckets, which ascend with the value, and a window
    inside each bucket, so no task holds or sorts all values of a group.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("k"))
    c = c.withColumn("b", F.floor(F.signum("v") * F.log2(F.abs("v") + 1) * 64))
    w = Window.partitionBy(*by)
    total = c.groupBy(*by, "b").agg(F.sum("k").alias("kb"))
    total = total.select(*by, "b", (F.sum("kb").over(w.orderBy("b")) - F.col("kb")).alias("below"), F.sum("kb").over(w).alias("n"))
    return c.join(total, [*by, "b"]).select(*by, "v", "k", (F.col("below") + F.sum("k").over(Window.partitionBy(*by, "b").orderBy("v"))).alias("upto"), "n")


def medians_by(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, name): exact medians, the mean of the two middle values where a group has an even number."""
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return ranked_by(df, by, value).groupBy(*by).agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias(name))


def floor_index(q: float, n: int) -> int:
    """The index of a quantile by the floor rule."""
    return min(int(q * n), n - 1)


def nearest_index(q: float, n: int) -> int:
    import math

    return min(max(math.ceil(q * n) - 1, 0), n - 1)


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """(bin, count) of equal-width bins from the least to the greatest value, the last one closed; empty bins included."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    counts = v.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("count"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
