from weir import config
from weir.operators import decode
from weir.sources import maps
from weir.sources.trace import COLUMNS, SCHEMA


def test_maps(spark):
    lines = spark.createDataFrame([(1, "00400000-00452000 r-xp 00001000 08:02 173521 /usr/bin/dbus-daemon"), (1, "7f0000000000-7f0000100000 r-xp 00000000 08:02 1 /lib/libc.so.6"), (1, "junk")], "pid long, line string")
    ips = spark.createDataFrame([(1, 0x400010), (1, 0x7F00000FFFFF), (1, 5), (2, 0x400010)], "pid long, ip long")
    got = {(r.pid, r.ip): r.symbol for r in maps.resolve(ips, maps.parse_maps(lines)).collect()}
    assert got == {(1, 0x400010): "dbus-daemon+0x1010", (1, 0x7F00000FFFFF): "libc.so.6+0xfffff", (1, 5): "0x5", (2, 0x400010): "0x400010"}


def test_decode(spark):
    row = {"file": "f", "seq": 0, "type": 7, "op": 7, "ts": 2_000_000, "cpu": 1, "pid": 5, "runtime": 9}
    e = spark.createDataFrame([tuple(row.get(c) for c in COLUMNS), tuple({**row, "seq": 1, "type": 9, "ts": 5_000_000, "signal": 11}.get(c) for c in COLUMNS)], SCHEMA)
    assert [tuple(r) for r in decode.as_csv(e).collect()] == [("f", 0, "SCHED", "WAKE2RUN", 0.0, 5, None, 1, 9)]
    assert decode.as_text(e).orderBy("seq").collect()[1].line == "5000000 SIGNAL pid=5 cpu=1 op=7 runtime=9 signal=11"
    o = spark.createDataFrame([("t", "1", "a", 5.0, 1), ("t", "2", "a", 9.0, 1), ("t", "3", "b", 1.0, 1), ("t", "4", "c", 0.0, 2)], "kind string, id string, metric string, value double, sev int")
    assert [r.id for r in decode.rank_offenders(o).collect()] == ["4", "2", "3", "1"]
    d = spark.createDataFrame([("a", "sched", "FAST"), ("b", "sched", "FAST"), ("c", "sched", "MIXED")], "recording string, report string, class string")
    assert [tuple(r) for r in decode.digest(d).collect()] == [("sched", "FAST", 2, "b"), ("sched", "MIXED", 1, "c")]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("[alert]\nthreshold = 80.0\n[own]\nx = 1\n")
    got = config.load(str(tmp_path / "c.toml"), {"WEIR_ALERT_SECONDS": "5", "WEIR_OWN_X": "7"})
    assert got["alert"] == {"threshold": 80.0, "seconds": 5.0} and got["own"]["x"] == 7
