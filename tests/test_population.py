import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.functions import inference as I
from weir.operators import population
from weir.sources import prometheus as P


def write_archive(folder, versions=10, runs=3, shift_at=6):
    """Files of versions and runs: a latency that is half as high again from one version on, memory that stays, a histogram beside them."""
    r = random.Random(42)
    for v in range(1, versions + 1):
        for run in range(runs):
            lines = ["early 1", f'gate_info{{version="1.{v}.0",git_commit="c{v:03d}"}} 1', "# TYPE gate_lat_us histogram"]
            for c in (2, 4):
                lat = (100.0 if v < shift_at else 150.0) * (1 + 0.05 * r.random()) * (1 + 0.1 * (c == 4))
                lines += [f'gate_lat_us_p99{{cores="{c}"}} {lat:.2f}', f'gate_rss_kb{{cores="{c}"}} {50 * (1 + 0.05 * r.random()):.2f}']
                lines += [f'gate_lat_us_bucket{{cores="{c}",le="{le}"}} {n}' for le, n in (("100", 10), ("200", 15 + v), ("+Inf", 17 + v))]
            (folder / f"1.{v}.0-2026{v:02d}01-{run:06d}.prom").write_text("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    write_archive(d)
    (d / "analysis-x.prom").write_text("gate_rss_kb 1\n")
    return P.with_run(P.read_archive(spark, str(d)), {"old": "/1.", "tenth": "/1.10."})


def test_the_jump_is_found_and_nothing_else(archive):
    c = P.cells(archive, "version")
    got = population.changes(c).collect()
    assert sorted((r.metric, r.cell, r.before, r.after) for r in got) == [("gate_lat_us_p99", f'[{{"key":"cores","value":"{c}"}}]', "1.5.0", "1.6.0") for c in (2, 4)]
    assert all(r.delta == 1.0 and r.strength == "large" and r.mean_after > 1.4 * r.mean_before for r in got)
    d = {(r.metric, r.axis): (r.cells, r.runs) for r in population.digest(c).collect()}
    assert d["gate_rss_kb", "1.10.0"] == (2, 6) and len(d) == 20
    assert population.changes(c.limit(0)).count() == 0


def test_labels_are_those_of_the_info_before(spark, archive):
    assert archive.where("name = 'early'").select("version").distinct().collect()[0].version is None
    assert {r["group"] for r in archive.where("version = '1.10.0'").select("group").collect()} == {"tenth"} and archive.where("version = '1.9.0' and group = 'old'").count() > 0
    s = spark.createDataFrame([("f", n, name, {"version": v} if v else {}, 1.0, None) for n, (name, v) in enumerate((("a", None), ("x_info", "1"), ("a", None), ("x_info", "2"), ("a", None)))], P.SCHEMA)
    assert [r.version for r in P.with_run(s).orderBy("line_no").collect()] == [None, "1", "2"]


def test_gauges_are_backed_by_the_longest_prefix(spark, archive):
    h = P.histogram_cells(archive, "version")
    got = P.backed_by_histograms(P.cells(archive, "version"), h)
    assert {r.metric for r in got.select("metric").distinct().collect()} == {"gate_lat_us_p99"}
    one = sorted((round(r.midpoint, 3), r.n) for r in got.where("axis = '1.2.0' and cell like '%4%'").collect())
    assert one == sorted([(50.0, 10), (141.421, 7), (200.0, 2)] * 3)  # three runs
    names = lambda xs: spark.createDataFrame([(x,) for x in xs], "metric string")
    gauges = ["a_b_c_p99", "a_b_p99", "a_p99", "ab_c", "a", "a_", "a_b", "_x", "a__b"]
    hists = ["a", "a_b", "a_b_c", "b", ""]
    want = {g: max((x for x in hists if x and g.startswith(x + "_") and len(g) > len(x) + 1), key=len, default=None) for g in gauges}
    assert {r.metric: r.prefix for r in P.longest_prefix(names(gauges), names(hists)).collect()} == {g: x for g, x in want.items() if x}
    plan = P.longest_prefix(names(gauges), names(hists))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_aliases_and_filters(archive):
    r = P.rename(archive, {"gate_rss_kb": "memory"}, {"cores": "cpus", "le": "cores"})
    assert r.where("name = 'memory' and labels['cpus'] is not null").count() == 60 and r.where("name = 'gate_rss_kb'").count() == 0
    assert {x.name for x in P.choose(archive, "gate", "bucket").select("name").distinct().collect()} == {"gate_lat_us_p99", "gate_rss_kb"}
    assert P.rename(archive, {}).count() == archive.count() == P.choose(archive).count()


def test_orders_are_scanned_at_once():
    r = np.random.default_rng(3)
    levels = [r.integers(0, 9, n).tolist() for n in (3, 1, 4, 2, 3)]
    orders = list(itertools.permutations(range(5)))
    assert np.allclose(I._scans(levels, np.array(orders)), [I.rank_scan([levels[i] for i in o])[:2] for o in orders])
    seven = [list(r.normal(50, 1, 3)) for _ in range(4)] + [list(r.normal(80, 1, 3)) for _ in range(3)]
    assert I.trajectory(seven, 0.12) == I.trajectory(seven, 0.12, seed=9) == [4] and I.trajectory(seven) == []  # exact: 2 * 288 of 5040 orders, whatever the seed
