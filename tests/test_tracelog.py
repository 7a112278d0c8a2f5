import io
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weir.sources import trace as T
from weir.sources import tracelog as L


def small_log(n=3000, seed=1):
    r = random.Random(seed)
    out = [T.header("p", 5_000_000_000, 1_700_000_000_000_000_000)]
    for i in range(n):
        kind = r.choice((T.SCHED, T.NTSYNC, T.HEAP, T.PROVIDER, T.IO, 999, T.SIGNAL))
        if kind == 999:  # unknown, of any length
            body = struct.pack("<I", 999) + bytes(r.randrange(60))
            out.append(struct.pack("<I", len(body)) + body)
        elif kind == T.PROVIDER:
            out.append(T.pack(kind, ts=i, name="x", payload="é" * r.randrange(300)))
        else:
            out.append(T.pack(kind, pid=i, ts=i * 1000, op=1, stack=[1, 2], depth=2) if kind == T.SIGNAL else T.pack(kind, pid=i, ts=i * 1000, op=1))
    return b"".join(out)


@pytest.mark.parametrize("tail", [b"", b"\x40\x00\x00\x00cut", struct.pack("<I", 2) + b"ab", struct.pack("<I", T.LARGEST + 1), b"\x01\x02"])
def test_splits_equal_the_whole(spark, tmp_path, tail, monkeypatch):
    monkeypatch.setattr(L, "STEP", 64)
    for k in (1, 2):
        (tmp_path / f"{k}.mtk").write_bytes(small_log(seed=k) + tail)
    (tmp_path / "empty.mtk").write_bytes(T.header("none"))
    got = L.read_trace_splits(spark, str(tmp_path), split=20_000)
    whole = T.read_traces(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 20 and got.schema == whole.schema
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert got.where("file like '%/1.mtk'").count() == sum(1 for _ in T.records(small_log(seed=1)))
    some = L.read_trace_splits(spark, str(tmp_path), types=(T.SCHED, T.HEAP), split=20_000)
    assert {r.type for r in some.select("type").distinct().collect()} == {T.SCHED, T.HEAP} and some.count() == whole.where("type in (7, 8)").count()


def test_headers_keep_their_anchors(spark, tmp_path):
    (tmp_path / "a.mtk").write_bytes(small_log(3))
    h = L.read_headers(spark, str(tmp_path)).first()
    assert (h.version, h.mono, h.real, h.pattern) == (1, 5_000_000_000, 1_700_000_000_000_000_000, "p")
    at = spark.range(1).select(F.lit(7_500_000_000).alias("ts")).select(T.wall_clock(h.mono, h.real).alias("t"))
    assert at.select(F.unix_micros("t").alias("t")).first().t == 1_700_000_002_500_000


def test_logs_that_are_none_or_have_changed(spark, tmp_path):
    (tmp_path / "a.mtk").write_bytes(b"x" * 100)
    with pytest.raises(Exception, match="not a trace log"):
        L.index_traces(spark, str(tmp_path))
    (tmp_path / "a.mtk").write_bytes(T.header("none"))
    assert L.read_trace_splits(spark, str(tmp_path)).count() == 0
    log = small_log(100)
    (tmp_path / "a.mtk").write_bytes(log)
    df = L.read_trace_splits(spark, str(tmp_path))
    (tmp_path / "a.mtk").write_bytes(log[: T.HEADER.size] + b"\xff" * (len(log) - T.HEADER.size))
    with pytest.raises(Exception, match="has changed"):
        df.count()


def test_stretches_cover_a_log_once():
    log = small_log(500)
    for split in (1, 1000, 10**9):
        rows = list(L.walk(pa.BufferReader(log), split))
        assert rows[0][0] == T.HEADER.size and rows[-1][1] == len(log) and all(a[1] == b[0] for a, b in zip(rows, rows[1:]))
        assert len(rows) == 500 if split == 1 else len(rows) >= 1


def test_a_log_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: records of an unknown type, a megabyte each, and known ones at both ends and on either side of 2 GB."""
    path, rec = tmp_path / "big.mtk", T.pack(T.SCHED, pid=7, op=2, ts=1)
    n, seq, want = (1 << 20) - 4, 0, []
    with open(path, "wb") as f:
        f.write(T.header("big"))
        for i in range(2300):
            if i in (0, 1000, 2040, 2060, 2299):
                want.append(seq)
                f.write(rec)
                seq += 1
            f.write(struct.pack("<2I", n, 500))
            f.seek(n - 4, io.SEEK_CUR)
            seq += 1
        want.append(seq)
        f.write(rec)
    assert path.stat().st_size > 2 << 30
    df = L.read_trace_splits(spark, str(path))
    assert df.rdd.getNumPartitions() >= 16 and [r.seq for r in df.where("pid = 7").orderBy("seq").collect()] == want
