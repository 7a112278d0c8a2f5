"""Traces as text and as CSV, offenders across reports, and recordings digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.sources.trace import KSTRAND, SCHED

TYPE_NAMES = {1: "FORK", 2: "EXEC", 3: "EXIT", 4: "COMM", 5: "IO", 6: "NTSYNC", 7: "SCHED", 8: "HEAP", 9: "SIGNAL", 10: "MMAP", 11: "PROVIDER", 12: "ABORT", 13: "HEAPSTACK", 14: "KEYEDEVT", 15: "KSTRAND", 16: "WAITSTACK", 17: "STORM", 18: "NAME", 19: "RAWSTACK", 20: "DROPS"}
SCHED_OPS = {1: "ENQUEUE", 2: "PICK", 3: "PICK_EMPTY", 4: "PREEMPT_TICK", 5: "PREEMPT_WAKEUP", 6: "WAKEUP", 7: "WAKE2RUN", 8: "CPU_IDLE", 9: "SWITCH_IN", 10: "FIELD_GATE", 11: "KICK_ISSUE", 12: "RESCHED", 13: "TICK_STOP"}


def _names(column: str, names: dict[int, str]):
    return F.coalesce(F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.lit(v))))[F.col(column)], F.col(column).cast("string"))


def as_csv(events: DataFrame) -> DataFrame:
    """type, op, elapsed_ms, pid, tid, cpu, detail of scheduler and strand records, in order."""
    start = events.agg(F.min(F.when(F.col("ts") > 0, F.col("ts"))).alias("t0"))
    e = events.where(F.col("type").isin(SCHED, KSTRAND)).join(F.broadcast(start))
    return e.select("file", "seq", _names("type", TYPE_NAMES).alias("type"), F.when(F.col("type") == SCHED, _names("op", SCHED_OPS)).alias("op"), F.round((F.col("ts") - F.col("t0")) / 1e6, 3).alias("elapsed_ms"), "pid", "tid", "cpu", F.col("runtime").alias("detail"))


def as_text(events: DataFrame) -> DataFrame:
    """A line a record."""
    pairs = [F.concat(F.lit(f" {c}="), F.col(c).cast("string")) for c in ("pid", "tid", "cpu", "op", "fd", "result", "obj", "addr", "size", "runtime", "dur", "signal", "comm")]
    return events.select("file", "seq", F.concat(F.coalesce(F.col("ts").cast("string"), F.lit("-")), F.lit(" "), _names("type", TYPE_NAMES), *(F.coalesce(p, F.lit("")) for p in pairs)).alias("line"))


def rank_offenders(offenders: DataFrame) -> DataFrame:
    """offenders (kind, id, metric, value, sev) by severity, then by rank within the metric; a lone one of its metric ranks 1."""
    w = Window.partitionBy("metric")
    norm = F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.percent_rank().over(w.orderBy("value")))
    return offenders.withColumn("norm", norm).orderBy(F.desc("sev"), F.desc("norm"), "metric", "id")


def digest(reports: DataFrame) -> DataFrame:
    """How many recordings (recording, report, class) fall in each class of each report, and the latest of them."""
    return reports.groupBy("report", "class").agg(F.count("*").alias("recordings"), F.max("recording").alias("latest")).orderBy("report", F.desc("recordings"), "class")
