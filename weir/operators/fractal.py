"""Scaling of event rates: detrended fluctuations, rescaled ranges and bursts of a binned timeline, all in built-in functions.

The timeline may have any number of bins: prefix sums are made by chunks, segments of every scale are groups of a few
sums, and only a row a scale is left for the fits. What meets in one window is chunks, and distinct counts and burst
sizes, which a sum of n events has about the square root of n of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.session import settle

#: Bins of a chunk, bins that a timeline aims at, narrowest and widest bin in nanoseconds.
CHUNK, BINS, NARROW, WIDE = 4096, 120_000, 10_000, 10_000_000
#: Least bins of a series; scales of a fit that count; scales that are tried, from 4 to a quarter of the bins; least active bins and bursts.
LEAST, FITTED, SCALES, ACTIVE, BURSTS = 32, 3, 14, 8, 5
#: What the scales of detrended fluctuations and of rescaled ranges are, of bins.
_DFA = f"array_distinct(filter(transform(sequence(0, {SCALES - 1}), j -> cast(floor(power(10D, log10(4D) + (log10(double(greatest(8, bins div 4))) - log10(4D)) * j / {SCALES - 1}D)) as long)), s -> s >= 4))"
_RS = "case when bins >= 16 then transform(sequence(3, cast(floor(log2(bins div 2)) as int)), k -> cast(power(2, k) as long)) else array() end"


def timeline(events: DataFrame, **series: Column) -> DataFrame:
    """(series, bin, chunk, bins, v, upto): counts by bin of the rows of events (ts) where each series' condition holds, empty bins included, and the sum up to each bin.

    Bins are as wide as makes BINS of them from first to last event, NARROW to WIDE; no events, or all at one time: no bins.
    """
    ends = events.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    ends = ends.withColumn("width", F.expr(f"least(greatest((t1 - t0) div {BINS}, {NARROW}), {WIDE})")).withColumn("bins", F.expr("if(t1 > t0, (t1 - t0) div width + 1, 0)"))
    counts = events.join(F.broadcast(ends)).groupBy(F.expr("(ts - t0) div width").alias("bin")).agg(*(F.count_if(c).alias(n) for n, c in series.items()))
    chunks = ends.where("bins > 0").select("bins", F.explode(F.expr(f"sequence(0L, (bins - 1) div {CHUNK})")).alias("chunk")).repartition("chunk")
    bins = chunks.select("bins", "chunk", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(chunk * {CHUNK} + {CHUNK}, bins) - 1)")).alias("bin"))
    each = F.explode(F.array(*(F.struct(F.lit(n.replace("_", "-")).alias("series"), F.coalesce(n, F.lit(0)).alias("v")) for n in series))).alias("s")
    rows = bins.join(counts, "bin", "left").select("bin", "chunk", "bins", each).select("bin", "chunk", "bins", "s.*")
    sums = rows.groupBy("series", "chunk").agg(F.sum("v").alias("sum"))
    sums = sums.select("series", "chunk", (F.sum("sum").over(Window.partitionBy("series").orderBy("chunk")) - F.col("sum")).alias("before"))
    own = F.sum("v").over(Window.partitionBy("series", "chunk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return settle(rows.withColumn("own", own).join(sums, ["series", "chunk"]).select("series", "bin", "chunk", "bins", "v", (F.col("before") + F.col("own")).alias("upto")), "timeline")


def _fit(points: DataFrame) -> DataFrame:
    """(series, slope, error, decades) of y against x by series; null where fewer than FITTED points are."""
    sse = F.greatest(F.regr_syy("y", "x") - F.regr_sxy("y", "x") ** 2 / F.regr_sxx("y", "x"), F.lit(0.0))
    n = F.count("*")
    fit = points.groupBy("series").agg(n.alias("n"), F.regr_slope("y", "x").alias("slope"), F.sqrt(sse / (n - 2) / F.regr_sxx("y", "x")).alias("error"), ((F.max("x") - F.min("x")) / F.log(F.lit(10.0))).alias("decades"))
    return fit.where(F.col("n") >= FITTED).drop("n")


def dfa(line: DataFrame) -> DataFrame:
    """(series, slope, error, decades): how the residual about a line through each segment of the summed deviations grows with the segment's length."""
    mean = line.groupBy("series").agg((F.sum("v") / F.count("*")).alias("mean"))
    rows = line.join(F.broadcast(mean), "series").select("series", "bin", "bins", (F.col("upto") - (F.col("bin") + 1) * F.col("mean")).alias("y"), F.explode(F.expr(_DFA)).alias("s")).where("bin < bins div s * s")
    t = F.col("bin") % F.col("s") - (F.col("s") - 1) / 2
    seg = rows.groupBy("series", "s", F.expr("bin div s").alias("seg")).agg(F.sum("y").alias("sy"), F.sum(F.col("y") ** 2).alias("syy"), F.sum(t * F.col("y")).alias("sty"))
    sse = F.greatest(F.expr("syy - sy * sy / s - sty * sty * 12 / (s * (double(s) * s - 1))"), F.lit(0.0))
    return _fit(seg.groupBy("series", "s").agg(F.sqrt(F.avg(sse / F.col("s"))).alias("f")).where("f > 1e-9").select("series", F.log(F.col("s").cast("double")).alias("x"), F.log("f").alias("y")))


def rescaled_range(line: DataFrame) -> DataFrame:
    """(series, slope, error, decades) of the range of a segment's summed deviations over its deviation, by the segment's length (powers of two)."""
    rows = line.select("series", "bin", "bins", "v", "upto", F.explode(F.expr(_RS)).alias("s")).where("bin < bins div s * s").withColumn("seg", F.expr("bin div s"))
    key = ["series", "s", "seg"]
    facts = rows.groupBy(*key).agg(F.min(F.col("upto") - F.col("v")).alias("before"), F.expr("(max(upto) - min(upto - v)) / s").alias("mu"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    z = F.expr("upto - before - (bin % s + 1) * mu")
    seg = rows.join(facts, key).groupBy(*key).agg(F.greatest(F.max(z), F.lit(0.0)).alias("hi"), F.least(F.min(z), F.lit(0.0)).alias("lo"), F.expr("sqrt(greatest(first(vv) / s - first(mu) * first(mu), 0))").alias("sd"))
    return _fit(seg.where("sd > 1e-12").groupBy("series", "s").agg(F.avg(F.expr("(hi - lo) / sd")).alias("r")).where("r > 0").select("series", F.log(F.col("s").cast("double")).alias("x"), F.log("r").alias("y")))


def bursts(line: DataFrame) -> DataFrame:
    """(series, burst, size): runs of bins above the median of those that aren't empty, with the events in them; burst is the run's last bin.

    Runs are told by the last quiet bin before each, first in a chunk and, where a chunk begins in a run, from the chunks before.
    """
    half = line.where("v > 0").groupBy("series", "v").agg(F.count("*").alias("k")).groupBy("series").agg(F.expr("percentile(v, 0.5, k)").alias("median"), F.sum("k").alias("active"))
    rows = line.join(F.broadcast(half.where(F.col("active") >= ACTIVE)), "series").select("series", "bin", "chunk", "v", (F.col("v") > F.col("median")).alias("up"))
    quiet = F.when(~F.col("up"), F.col("bin"))
    ends = rows.groupBy("series", "chunk").agg(F.max(quiet).alias("quiet"))
    before = Window.partitionBy("series").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("series", "chunk", F.coalesce(F.max("quiet").over(before), F.lit(-1)).alias("earlier"))
    inside = F.max(quiet).over(Window.partitionBy("series", "chunk").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("since", inside).join(ends, ["series", "chunk"]).where("up")
    return rows.groupBy("series", F.coalesce("since", "earlier").alias("since")).agg(F.max("bin").alias("burst"), F.sum("v").alias("size")).select("series", "burst", "size")


def tail(sizes: DataFrame) -> DataFrame:
    """(series, avalanches, slope): number of bursts, and the slope of the share of bursts at least as large against the size, both as logarithms; from BURSTS on."""
    by = sizes.groupBy("series", "size").agg(F.count("*").alias("k"))
    all_ = F.sum("k").over(Window.partitionBy("series"))
    by = by.select("series", "size", "k", all_.alias("n"), (F.sum("k").over(Window.partitionBy("series").orderBy("size")) - F.col("k")).alias("below"))
    # Bursts of one size have ranks of their own; the fit needs only the sums over them.
    logs = F.expr("aggregate(sequence(n - below - k + 1, n - below), 0D, (a, r) -> a + ln(r / n))")
    x = F.log("size")
    sums = by.select("series", "k", "n", x.alias("x"), logs.alias("y")).groupBy("series").agg(F.max("n").alias("avalanches"), F.sum(F.expr("k * x")).alias("sx"), F.sum(F.expr("k * x * x")).alias("sxx"), F.sum("y").alias("sy"), F.sum(F.expr("x * y")).alias("sxy"))
    return sums.where(F.col("avalanches") >= BURSTS).select("series", "avalanches", F.expr("(avalanches * sxy - sx * sy) / nullif(avalanches * sxx - sx * sx, 0)").alias("slope"))
