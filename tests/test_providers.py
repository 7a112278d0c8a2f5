import os
import socket
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from weir.sources.prometheus import samples_of
from weir.streaming import providers as P


class Provider:
    """A socket that answers each caller with the current text, after a delay, and closes."""

    def __init__(self, path, text, delay=0.0):
        self.text, self.delay, self.asked = text, delay, 0
        self.s = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
        self.s.bind(str(path))
        self.s.listen()
        threading.Thread(target=self.serve, daemon=True).start()

    def serve(self):
        while True:
            try:
                c, _ = self.s.accept()
            except OSError:
                return
            self.asked += 1
            time.sleep(self.delay)
            try:
                c.sendall(self.text.encode())
            except OSError:
                pass
            c.close()


@pytest.fixture
def folder(tmp_path):
    os.chdir(tmp_path)  # socket paths are short
    (tmp_path / "p").mkdir()
    return tmp_path


def test_samples_pass_over_garbled_lines():
    text = '# TYPE a counter\n  a{x="1"} 2 1700000000 \r\nb\nc{x="1" 3\nd xyz\n{x="1"} 4\n# c\n\nh_bucket{le="+Inf"} +Inf\ne NaN'
    got = list(samples_of(text))
    assert [(n, name, kind) for n, name, _, _, kind in got] == [(2, "a", "counter"), (9, "h_bucket", None), (10, "e", None)] and got[0][2:4] == ({"x": "1"}, 2.0) and got[1][3] == float("inf")


def test_scrapes_skip_what_does_not_answer(folder):
    Provider("p/good.sock", "a 1\n")
    Provider("p/slow.sock", "a 1\n", delay=1.0)
    Provider("p/junk.sock", "<html>\n")
    Provider("p/weir.sock", "a 1\n")
    (folder / "p/dead.sock").write_text("")
    (folder / "p/note.txt").write_text("a 1\n")
    r = P.ProviderReader({"path": str(folder / "p"), "spool": str(folder / "s"), "urls": "gone=http://127.0.0.1:1/x", "deadlineMs": "200"})
    assert list(r._scrape()["texts"]) == ["good"]
    with pytest.raises(ValueError):
        P.ProviderReader({"path": "x"})


def test_offsets_replay_what_was_scraped(folder):
    p = Provider("p/a.sock", "a 1\n")
    options = {"path": str(folder / "p"), "spool": str(folder / "s"), "deadlineMs": "500"}
    r = P.ProviderReader(options)
    rows, end = r.read(r.initialOffset())
    first = list(rows)
    assert end == {"scrape": 1} and [(x[0], x[1], x[4], x[6]) for x in first] == [("a", 0, "a", 1.0)]
    p.text = "a 2\nb 3\n"
    again = P.ProviderReader(options)  # after a failure before the offset counted
    assert list(again.read({"scrape": 0})[0]) == first and list(again.readBetweenOffsets({"scrape": 0}, end)) == first and p.asked == 1
    rows, end = again.read(end)
    assert [x[6] for x in rows] == [2.0, 3.0] and end == {"scrape": 2}
    again.commit({"scrape": 1})
    assert [x[1] for x in again.readBetweenOffsets({"scrape": 1}, {"scrape": 2})] == [1, 1]
    with pytest.raises(ValueError):
        list(again.readBetweenOffsets({"scrape": 0}, {"scrape": 1}))
    none = P.ProviderReader(options | {"path": str(folder / "nowhere"), "spool": str(folder / "t")})
    rows, end = none.read({"scrape": 0})
    assert list(rows) == [] and end == {"scrape": 0}


def test_stream_restarts_and_snapshot(spark, folder):
    p = Provider("p/a.sock", '# TYPE a gauge\na{x="1"} 1\na{x="2"} 5\n')
    q = Provider("p/b.sock", 'a{x="1"} 7\n')
    snap, seen = P.LatestSnapshot(f"file://{folder}/snap"), f"file://{folder}/seen"
    assert snap.read(spark).count() == 0

    def once(failing=False):
        def sink(batch, n):
            batch.write.mode("overwrite").parquet(f"{seen}/{n}")
            snap(batch, n)
            if failing:
                raise RuntimeError("lost")

        df = P.read_providers(spark, str(folder / "p"), spool=f"file://{folder}/spool", deadline_ms=2000)
        query = df.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{folder}/ck").trigger(availableNow=True).start()
        try:
            query.awaitTermination(60)
        finally:
            query.stop()

    latest = lambda: {(r.provider, r.labels["x"]): r.value for r in snap.read(spark).collect()}
    once()
    assert latest() == {("a", "1"): 1, ("a", "2"): 5, ("b", "1"): 7}
    p.text = 'a{x="1"} 2\n'
    with pytest.raises(Exception, match="lost"):
        once(failing=True)
    asked, p.text = p.asked, 'a{x="1"} 3\n'
    before = latest()
    once()  # the failed batch again, with what was scraped then
    held = {n: {(r.provider, r.labels["x"]): r.value for r in spark.read.parquet(f"{seen}/{n}").collect()} for n in (0, 1)}
    assert held[1] == {("a", "1"): 2, ("b", "1"): 7} and before == {("a", "1"): 2, ("a", "2"): 5, ("b", "1"): 7} and p.asked >= asked
    once()
    assert latest() == {("a", "1"): 3, ("a", "2"): 5, ("b", "1"): 7}
    assert len([n for n in os.listdir(folder / "snap") if n.startswith("v-")]) <= 2  # older versions go
    server = P.MetricsServer(spark, snap)
    lines = urllib.request.urlopen(server.url).read().decode().split("\n")
    assert lines == ["# TYPE a gauge", 'a{provider="a",x="1"} 3.0', 'a{provider="a",x="2"} 5.0', 'a{provider="b",x="1"} 7.0', ""]
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(server.url.replace("/metrics", "/x"))
    scraped = P.ProviderReader({"urls": f"self={server.url}", "spool": "x", "deadlineMs": "20000"})._scrape()  # what is served can be scraped
    server.close()
    assert [v for _, _, _, v, _ in samples_of(scraped["texts"]["self"])] == [3.0, 5.0, 7.0] and q.asked


def test_snapshot_is_idempotent_and_forgets(spark, folder):
    snap = P.LatestSnapshot(f"file://{folder}/snap", stale=10)
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    rows = lambda scrape, s, *vs: spark.createDataFrame([("p", scrape, i, n, {"q": 'a"\\\n'}, v, None) for i, (n, v) in enumerate(vs)], "provider string, scrape long, line_no int, name string, labels map<string,string>, value double, type string").withColumn("scraped", at(s)).select(*(c.split()[0] for c in P.SAMPLES.split(", ")))
    now = lambda: {r.name: r.value for r in snap.read(spark).collect()}
    snap(rows(0, 0, ("a", 1.0), ("b", 1.0), ("a", 2.0)), 0)
    assert now() == {"a": 2.0, "b": 1.0}  # of repeated series in a scrape the last line
    for _ in range(2):
        snap(rows(1, 5, ("a", 3.0)), 1)
        assert now() == {"a": 3.0, "b": 1.0}
    snap(rows(2, 12, ("a", float("-inf"))), 2)
    assert now() == {"a": float("-inf")}
    assert [r.line for r in P.render(snap.read(spark)).collect()] == ['a{provider="p",q="a\\"\\\\\\n"} -Inf']
    os.makedirs(folder / "snap/v-000000000009")  # a version that was never finished
    assert now() == {"a": float("-inf")}
