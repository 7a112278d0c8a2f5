"""Live snapshots as streams: rates, sustained-threshold alerts, churn windows, sessions, and the sinks that publish them.

Each function takes a streaming (or plain) DataFrame and returns one; state lives in Spark's state store under the
query's checkpoint, and a watermark bounds it. Rows later than the watermark are dropped and counted by the query's
progress (numRowsDroppedByWatermark).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT, LEVEL_SCHEMA = "key string, ts timestamp, level string, value double", "since double, last double, fired boolean"


def tumbling(df: DataFrame, ts: str, every: str, *by: str, late: str = "1 hour") -> DataFrame:
    """Counts and means by window."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def churn(df: DataFrame, ts: str, span: str = "2 seconds", step: str = "250 milliseconds", late: str = "10 seconds", *by: str) -> DataFrame:
    """Events in a sliding window."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, span, step), *by).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, gap: str, *by: str, late: str = "1 hour") -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n"))


def sustained_alerts(df: DataFrame, key: str, threshold: float, seconds: float, level: str = "crit") -> DataFrame:
    """One alert each time a key's value (key, ts, value) has been at the threshold or above for so many seconds.

    State is three numbers a key; it goes after ten minutes without rows.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, last, fired = state.get if state.exists else (-1.0, -1.0, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"]):
            now = ts.timestamp()
            last = max(last, now)
            if value < threshold:
                since, fired = -1.0, False
            elif since < 0:
                since = now
            if since >= 0 and not fired and now - since >= seconds:
                fired = True
                out.append((k[0], ts, level, float(value)))
        state.update((float(since), float(last), bool(fired)))
        state.setTimeoutDuration(600_000)
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "level", "value"])

    rows = df.select(F.col(key).cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, ALERT, LEVEL_SCHEMA, "append", GroupStateTimeout.ProcessingTimeTimeout)


def counter_rates(df: DataFrame, key: str) -> DataFrame:
    """(key, ts, rate): change of a counter (key, ts, value) a second; a fall counts as 0, the first row of a key gives none."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was, at = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, value in zip(rows["ts"], rows["value"]):
            now = ts.timestamp()
            if at is not None and now > at:
                out.append((k[0], ts, max(value - was, 0.0) / (now - at)))
            was, at = float(value), now
        state.update((was, at))
        state.setTimeoutDuration(600_000)
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "rate"])

    rows = df.select(F.col(key).cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ts timestamp, rate double", "was double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def security_findings(processes: DataFrame, most: int = 100) -> DataFrame:
    """(pid, rule, severity) of process rows (pid, user, exe, cmd) that match a rule, the gravest first."""
    kernel = F.col("cmd").rlike(r"^\[[a-z]+") & (F.coalesce("exe", F.lit("")) != "")
    rules = (
        ("root-in-writable-path", 3, (F.col("user") == "root") & F.col("exe").rlike("^/(tmp|var/tmp|dev/shm|home)/")),
        ("kernel-thread-impostor", 3, kernel),
        ("download-to-shell", 3, F.col("cmd").rlike(r"(curl|wget)\b.*\|\s*(ba|z|da)?sh\b")),
        ("script-in-writable-path", 2, F.col("cmd").rlike(r"\b(ba|z|da)?sh\s+/(tmp|var/tmp|dev/shm)/")),
        ("python-from-home", 1, F.col("cmd").rlike(r"\bpython[0-9.]*\s+/home/")),
    )
    hits = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"))) for n, s, c in rules)), lambda x: x.isNotNull())
    return processes.select("pid", F.explode(hits).alias("h")).select("pid", "h.rule", "h.severity").orderBy(F.desc("severity"), "pid", "rule").limit(most)


def hourly_log(df: DataFrame, ts: str, path: str, checkpoint: str):
    """Start a query that writes rows to folders by date and hour."""
    out = df.withColumn("date", F.to_date(ts)).withColumn("hour", F.hour(ts))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("date", "hour").trigger(availableNow=True).start()


def exposition(df: DataFrame, name: str, value: str, labels: list[str], prefix: str = "weir_") -> DataFrame:
    """Rows as lines of the text exposition format."""
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\\\])', r"\\\\$1"), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(f"{prefix}{name}{{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))
