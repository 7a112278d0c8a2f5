"""Gauges with labels whose number grows with the trace: a row each, where a report's own gauges are a map in one row.

A detail is a function of the events that ends in (gauge, labels, value), labels being written as Prometheus has them.
Rows are made by grouping and stay distributed. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.operators import reports as R
from weir.operators import windows
from weir.operators.stream import ranked_by
from weir.sources.trace import NTSYNC

Detail = Callable[[DataFrame], DataFrame]
DETAILS: dict[str, Detail] = {}

#: Results shown of a thread and object; least of wakes that a profile is made of, its largest window, and its windows at least.
TOP_RESULTS, PROFILED, WIDEST, FEWEST = 4, 1024, 512, 8


def detail(name: str) -> Callable[[Detail], Detail]:
    def add(f: Detail) -> Detail:
        DETAILS[name] = f
        return f

    return add


def _label(**parts: Column) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in parts.items()))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _obj() -> Column:
    return F.format_string("0x%016x", "obj")


def _rows(df: DataFrame, *gauges: tuple[str, Column, Column]) -> DataFrame:
    """A row for each gauge (name, labels, value) of each row of df, those without a value left out."""
    all_ = F.array(*(F.struct(F.lit(n).alias("gauge"), labels.alias("labels"), v.cast("double").alias("value")) for n, labels, v in gauges))
    return df.select(F.explode(all_).alias("g")).select("g.*").where("value is not null")


def _quantile(q: float) -> Column:
    """Of ranked_by's rows of a group, by floor index."""
    return F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1), F.col("v")))


@detail("waits")
def waits(e: DataFrame) -> DataFrame:
    """Of each thread and object: completed waits, and quantiles of the times between them. Waits at one time have no time between them."""
    w = R.waits_of(e)
    gap = w.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("tid", "obj").orderBy("seq"))).where("gap > 0")
    q = ranked_by(gap, ["tid", "obj"], "gap").groupBy("tid", "obj").agg(_quantile(0.5).alias("p50"), _quantile(0.99).alias("p99"))
    each = w.groupBy("tid", "obj").agg(F.count("*").alias("waits")).join(q, ["tid", "obj"], "left")
    who = {"tid": _text("tid"), "obj": _obj()}
    return _rows(
        each, ("waits_total", _label(**who), F.col("waits")),
        *(("wait_gap_ms", _label(**who, quantile=F.lit(str(x))), F.col(c) / 1e6) for x, c in ((0.5, "p50"), (0.99, "p99"))),
    )


def wait_results(e: DataFrame) -> DataFrame:
    """(tid, obj, rank, result, n): the most frequent results of the waits of each thread and object, at most TOP_RESULTS; of equally frequent ones the smaller first."""
    n = R.waits_of(e).groupBy("tid", "obj", "result").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tid", "obj").orderBy(F.desc("n"), "result"))
    return n.withColumn("rank", rank).where(F.col("rank") <= TOP_RESULTS).select("tid", "obj", "rank", "result", "n")


@detail("spins")
def spins(e: DataFrame) -> DataFrame:
    """Of each thread, object and verdict the runs; of each thread and object the fastest run's waits a second."""
    runs = R.spin_runs(e)
    count = _rows(runs.groupBy("tid", "obj", "verdict").agg(F.count("*").alias("runs")), ("spin_runs_total", _label(tid=_text("tid"), obj=_obj(), verdict=F.col("verdict")), F.col("runs")))
    return count.union(_rows(runs.groupBy("tid", "obj").agg(F.max("rate").alias("peak")), ("spin_peak_rate_per_s", _label(tid=_text("tid"), obj=_obj()), F.col("peak"))))


@detail("pairing")
def pairing(e: DataFrame) -> DataFrame:
    """Of each object, by its descriptor: waits, signals, and whether its waits have no plausible signaler."""
    fd = _label(fd=_text("fd"))
    flag = (F.col("waits") >= 1000) & (F.col("waits") > 100 * F.col("signals"))
    return _rows(R.paired(e), ("pairing_waits", fd, F.col("waits")), ("pairing_signals", fd, F.col("signals")), ("unsignaled_flag", fd, flag.cast("int")))


def signal_kinds(e: DataFrame) -> DataFrame:
    """(fd, event_set, event_reset, sem_release, mutex_unlock): an object's signals by operation, 0 where there are none of a kind."""
    kinds = {"event_set": R.EVENT_SET, "event_reset": R.EVENT_RESET, "sem_release": R.SEM_RELEASE, "mutex_unlock": R.MUTEX_UNLOCK}
    s = e.where((F.col("type") == NTSYNC) & F.col("op").isin(*kinds.values()))
    return s.groupBy(F.col("fd").cast("long").alias("fd")).agg(*(F.count_if(F.col("op") == op).alias(name) for name, op in kinds.items()))


@detail("kstrand")
def kstrand(e: DataFrame) -> DataFrame:
    """Of each kernel thread, by name and CPU: its strands, which of them were held and dark, the longest and the 99th percentile. A thread without a name has an empty one."""
    s = R.strands(e).select(F.coalesce("comm", F.lit("")).alias("comm"), F.coalesce("cpu", F.lit(-1)).alias("cpu"), "runtime", "dark")
    q = ranked_by(s, ["comm", "cpu"], "runtime").groupBy("comm", "cpu").agg(_quantile(0.99).alias("p99"))
    each = s.groupBy("comm", "cpu").agg(F.count("*").alias("strands"), F.count_if("dark").alias("dark"), F.max("runtime").alias("worst")).join(q, ["comm", "cpu"], "left")
    who = {"comm": F.col("comm"), "cpu": _text("cpu")}
    return _rows(
        each, ("kstrand_events_total", _label(**who), F.col("strands")), ("kstrand_held", _label(**who), F.col("strands") - F.col("dark")), ("kstrand_dark", _label(**who), F.col("dark")),
        *(("kstrand_ms", _label(**who, quantile=F.lit(x)), F.col(c) / 1e6) for x, c in (("0.99", "p99"), ("worst", "worst"))),
    )


@detail("seat")
def seat(e: DataFrame) -> DataFrame:
    """Of each task that was switched in eight times or more: switches a wake, and the share of its most frequent CPU."""
    pid = _label(pid=_text("pid"))
    return _rows(R.seats(e), ("seat_stints", pid, F.col("stints")), ("seat_stint_wake_ratio", pid, F.col("ratio")), ("seat_cpu_share", pid, F.col("cpu_share")))


@detail("sched")
def sched(e: DataFrame) -> DataFrame:
    """The share of windows of wake latencies, in the order of records, that are not random: 0 of fewer than PROFILED wakes. Windows are an eighth of all wakes long, WIDEST at most."""
    lat = R.sched(e, R.WAKE2RUN).where("runtime is not null").select("seq", "runtime")
    n = lat.count()
    if n < PROFILED:
        share = lat.agg(F.when(F.count("*") > 0, 0.0).alias("share"))
    else:
        found = windows.profile(lat, "runtime", ["seq"], [], min(WIDEST, n // FEWEST))
        share = found.agg((100.0 * F.count_if(F.col("cls") != "RANDOM") / F.count("*")).alias("share"))
    return _rows(share, ("wake2run_structured_pct", F.lit(""), F.col("share")))


def details(events: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(report, gauge, labels, value) of the chosen reports."""
    out = None
    for n in names or list(DETAILS):
        rows = DETAILS[n](events).select(F.lit(n).alias("report"), "gauge", "labels", "value")
        out = rows if out is None else out.union(rows)
    return out


def to_prometheus(rows: DataFrame, prefix: str = "weir_") -> DataFrame:
    """A line a row. Lines of a family are not gathered: sort the written table by line, or read it by family."""
    label = F.concat(F.when(F.col("labels") != "", F.concat("labels", F.lit(","))).otherwise(""), F.lit('report="'), "report", F.lit('"'))
    return rows.select(F.concat(F.lit(prefix), "gauge", F.lit("{"), label, F.lit("} "), F.col("value").cast("string")).alias("line"))
