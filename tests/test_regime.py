import datetime as dt
import time

import numpy as np
import pytest

from weir.functions.kernels import spectral_residual
from weir.streaming import regime as R

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp, value double"


def samples(seed=3, keys=5, n=300):
    """By key, ten samples a second with a step in the middle; one key falls silent for two minutes, one is short."""
    r, out = np.random.default_rng(seed), []
    for k in range(keys):
        t = 0.0
        for i in range(20 if k == 4 else n):
            t += 120 if k == 3 and i == 150 else 0.1
            out.append((f"k{k}", T0 + dt.timedelta(seconds=t), float(r.normal(10, 0.1) + 50 * (i % 97 == 40) + 30 * (i > 200))))
    return out


def plain(rows, n, stride, warm, quiet):
    """Row by row."""
    out = []
    for key in {r[0] for r in rows}:
        first = last = None
        seen, ring = 0, []
        for _, ts, v in sorted(r for r in rows if r[0] == key):
            if last is not None and (ts - last).total_seconds() > quiet:
                first, seen, ring = None, 0, []
            first, last = first or ts, ts
            if (ts - first).total_seconds() < warm:
                continue
            seen += 1
            ring = [*ring, v][-n:]
            if seen >= n and (seen - n) % stride == 0:
                s, f = spectral_residual(np.array(ring), 3, 3.0, max(1, n // 4))
                out.append((key, ts, n, round(float(np.mean(ring)), 9), bool(f.any()), tuple((n - 1 - k, ring[k], round(float(s[k]), 9)) for k in np.flatnonzero(f))))
    return sorted(out)


def rows_of(df):
    return sorted((r.key, r.ts, r.samples, round(r["mean"], 9), r.shifted, tuple((s.samples_ago, s.value, round(s.saliency, 9)) for s in r.shifts)) for r in df.collect())


@pytest.mark.parametrize("n, stride, warm", [(30, None, 1.0), (16, 1, 0.0), (100, 7, 2.0)])
def test_replay_of_a_table(spark, n, stride, warm):
    rows = samples()
    df = spark.createDataFrame(rows + [(None, T0, 1.0), ("k0", None, 1.0), ("k0", T0, None), ("k0", T0, float("nan"))], SCHEMA)
    size = R.ring_size(n)
    want = plain(rows, size, stride or size, warm, 60)
    got = rows_of(R.regime(df.repartition(3), "key", n, stride, warm))
    assert got == want and any(r[4] for r in want) and len(want) > 8
    assert R.regime(df.limit(0), "key").count() == 0 and [R.ring_size(x) for x in (1, 16, 17, 200, 999)] == [16, 16, 32, 256, 256]


def test_stream_concludes_as_the_table_does(spark, tmp_path):
    rows = samples(keys=4, n=200)
    rows.sort(key=lambda r: r[1])
    parts = np.array_split(np.arange(len(rows)), 7)
    df = lambda p: spark.createDataFrame([rows[i] for i in p], SCHEMA).coalesce(1)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        q = R.regime(stream, "key", 30, 5).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda x: __import__("json").loads(x.json), q.recentProgress) if p["stateOperators"]]
        q.stop()
        return held

    for i, p in enumerate(parts):  # batches in order of time, and a restart half way
        df(p).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 if i in (2, 5) else 0.05)
        if i in (2, 6):
            held = run()
    got = rows_of(spark.read.schema(R.OUT).parquet(str(tmp_path / "out")))
    assert got == plain(rows, 32, 5, 1.0, 60) == rows_of(R.regime(spark.createDataFrame(rows, SCHEMA), "key", 30, 5))
    df([0]).selectExpr("'late' as key", "timestamp'2024-01-01 02:00:00' as ts", "value").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    (tmp_path / "in").joinpath("x").mkdir(exist_ok=True)
    df([0]).selectExpr("'late' as key", "timestamp'2024-01-01 02:00:01' as ts", "value").write.mode("append").parquet(str(tmp_path / "in"))
    held = run()
    assert held[-1] < 20  # the timers have freed the keys that are silent


def test_state_is_a_ring():
    ring, r = R.Ring(16, 4, 0, 10**9), np.random.default_rng(0)
    for k in range(50):
        list(ring.feed(np.arange(100) * 1000 + k * 100_000, r.normal(size=100)))
        assert len(ring.ts) == len(ring.v) == 16 and ring.seen == (k + 1) * 100
    assert list(ring.feed(np.array([5, 6]), np.zeros(2))) == [] and ring.seen == 5000  # late
    assert list(ring.feed(np.zeros(0, np.int64), np.zeros(0))) == []
