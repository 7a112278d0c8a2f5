"""Shifts in live signals: a ring of the last samples of each key, concluded upon as samples come in.

A key's samples are kept in a list state of a power of two of samples, 16 to 256. The first ones of a key are let pass
until it has been seen for a while (warm-up: differences over a moment say nothing yet). From then on, whenever the ring
is full and stride samples have come since the last conclusion, spectral residuals tell which of them stand out. A
timer frees the state of keys that have gone quiet, and what comes after starts anew. What is concluded depends on the
samples alone, not on how they were dealt into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weir.functions.kernels import spectral_residual

OUT = "key string, ts timestamp, samples int, mean double, shifted boolean, shifts array<struct<samples_ago:int,value:double,saliency:double>>"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def ring_size(n: int) -> int:
    """The power of two of samples, 16 to 256, that holds n."""
    return min(max(1 << max(n - 1, 1).bit_length(), 16), 256)


def conclude(values: np.ndarray) -> tuple[float, list[tuple[int, float, float]]]:
    """The mean of a ring, and (samples ago, value, saliency) of those that stand out against the quarter before them."""
    n = len(values)
    saliency, flags = spectral_residual(values, 3, 3.0, max(1, n // 4))
    return float(values.mean()), [(n - 1 - k, float(values[k]), float(saliency[k])) for k in np.flatnonzero(flags).tolist()]


class Ring:
    """What is known of a key: when its samples began (after the last silence), how many have counted, and the last of them; times are microseconds."""

    def __init__(self, n: int, stride: int, warm: int, quiet: int):
        self.n, self.stride, self.warm, self.quiet = n, stride, warm, quiet
        self.first, self.last, self.seen = None, None, 0
        self.ts, self.v = np.zeros(0, np.int64), np.zeros(0)

    def feed(self, ts: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        """(ts, mean, shifts) of each conclusion. Of samples of one time the last counts; those no later than what was fed before are late and pass."""
        order = np.argsort(ts, kind="stable")
        ts, v = ts[order], v[order]
        keep = np.append(ts[1:] != ts[:-1], True)[: len(ts)]
        keep &= ts > (self.last if self.last is not None else np.iinfo(np.int64).min)
        ts, v = ts[keep], v[keep]
        if not len(ts):
            return
        breaks = np.flatnonzero(np.diff(ts, prepend=ts[0] if self.last is None else self.last) > self.quiet)
        for k, (a, b) in enumerate(zip([0, *breaks], [*breaks, len(ts)])):
            if k:
                self.first, self.seen, self.ts, self.v = None, 0, self.ts[:0], self.v[:0]
            if a < b:
                yield from self._part(ts[a:b], v[a:b])
        self.last = int(ts[-1])

    def _part(self, ts: np.ndarray, v: np.ndarray) -> Iterator[tuple]:
        self.first = int(ts[0]) if self.first is None else self.first
        warm = ts >= self.first + self.warm
        ts, v = np.concatenate([self.ts, ts[warm]]), np.concatenate([self.v, v[warm]])
        before = self.seen - len(self.ts)  # samples that are gone from the ring
        seen = before + len(ts)
        at = max(self.seen + 1, self.n)
        at += -(at - self.n) % self.stride
        for s in range(at, seen + 1, self.stride):
            end = s - before
            yield int(ts[end - 1]), *conclude(v[end - self.n : end])
        self.seen, self.ts, self.v = seen, ts[-self.n :], v[-self.n :]


def _frame(key: str, n: int, found: list[tuple]) -> pd.DataFrame:
    rows = [(key, pd.Timestamp(t, unit="us"), n, mean, bool(shifts), [dict(zip(("samples_ago", "value", "saliency"), s)) for s in shifts]) for t, mean, shifts in found]
    return pd.DataFrame(rows, columns=_COLUMNS)


class RegimeProcessor(StatefulProcessor):
    """State: three numbers and at most a ring of samples a key. by_event: whether silence is told by the watermark or by the wall clock (then a time to live ends it too)."""

    def __init__(self, n: int, stride: int, warm: int, quiet: int, by_event: bool):
        self.facts, self.by_event = (n, stride, warm, quiet), by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = None if self.by_event else 2 * self.facts[3] // 1000
        self.meta = handle.getValueState("meta", "first long, last long, seen long", ttl)
        self.ring = handle.getListState("ring", "ts long, v double", ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = Ring(*self.facts)
        if self.meta.exists():
            ring.first, ring.last, ring.seen = self.meta.get()
            held = list(self.ring.get()) if self.ring.exists() else []
            ring.ts, ring.v = np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], float)
        frames = pd.concat(list(rows))
        ts = frames["ts"].to_numpy("datetime64[us]").astype(np.int64)
        found = list(ring.feed(ts, frames["value"].to_numpy(float)))
        if ring.last is not None:
            self.meta.update((ring.first, ring.last, ring.seen))
            if len(ring.ts):
                self.ring.put([(int(t), float(v)) for t, v in zip(ring.ts, ring.v)])
            elif self.ring.exists():
                self.ring.clear()
            now = ring.last // 1000 if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(now + self.facts[3] // 1000 + 1)
        yield _frame(key[0], self.facts[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.meta.clear()
        self.ring.clear()
        yield _frame(key[0], self.facts[0], [])

    def close(self) -> None:
        pass


def regime(df: DataFrame, key: str, n: int = 64, stride: int | None = None, warm: float = 1.0, quiet: float = 60.0, late: str = "10 seconds", by_event: bool = True) -> DataFrame:
    """(key, ts, samples, mean, shifted, shifts) each time stride more samples (a whole ring by default) of (key, ts, value) have come.

    df is a stream, or a table to replay: both give the same rows, if samples reach the stream in order of time but for
    what a batch holds. warm and quiet are seconds. Rows without key, time or value pass. A stream needs the RocksDB
    state store, which build_session sets.
    """
    size = ring_size(n)
    facts = (size, stride or size, int(warm * 1e6), int(quiet * 1e6))
    rows = df.select(F.col(key).cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value")).where("key is not null and ts is not null and value is not null and not isnan(value)")
    if not df.isStreaming:

        def replay(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
            ts = g["ts"].to_numpy("datetime64[us]").astype(np.int64)
            return _frame(k[0], size, list(Ring(*facts).feed(ts, g["value"].to_numpy(float))))

        return rows.groupBy("key").applyInPandas(replay, OUT)
    rows = rows.withWatermark("ts", late) if by_event else rows
    return rows.groupBy("key").transformWithStateInPandas(RegimeProcessor(*facts, by_event), OUT, "Append", "EventTime" if by_event else "ProcessingTime")
