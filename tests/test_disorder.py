import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.functions import disorder as D
from weir.operators import windows as W

NUMS = [5, 3, 8, 1, 9, 2, 7, 4, 6, 0, 3, 8]
LOC = [1, 2, 3, 4, 5, 6, 7, 8, 2, 9, 0, 5]


def test_known_profile_and_lenses():
    p = D.classify(NUMS)
    assert (p["cls"], round(p["inversion"], 3), p["lis"], p["distinct"], p["runs"]) == ("RANDOM", 0.515, 5, 10, 6)
    r = D.randomness(NUMS)
    assert (round(r["confidence"], 3), r["verdict"], r["k"], r["n"]) == (0.510, "consistent", 3, 4)
    assert [round(r[x], 2) for x in ("inversion", "distinct", "visibility", "ordinal")] == [0.97, 0.83, 0.58, 0.87] and r["hook"] is r["lis"] is r["recurrence"] is r["spectral"] is None


def test_tableau_by_brute_force():
    for n in range(1, 8):
        for v in itertools.permutations(range(n)):
            sizes = D.piles(v)
            best = [1] * n
            for i in range(n):
                best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
            assert len(sizes) == max(best) and sizes.sum() == n
            down = [1] * n
            for i in range(n):
                down[i] += max((down[j] for j in range(i) if v[j] > v[i]), default=0)
            assert sizes.max() <= max(down)
    assert D.piles([3, 3, 3]).tolist() == [3] and D.piles([]).tolist() == [] and D.lis_length([3, 1, 2, 2, 5, 4]) == 4


def fillings(rows):
    """Standard fillings of a diagram, by taking the last number off each corner."""
    if sum(rows) <= 1:
        return 1
    return sum(fillings([x for x in (*rows[:i], r - 1, *rows[i + 1 :]) if x]) for i, r in enumerate(rows) if i == len(rows) - 1 or rows[i + 1] < r)


def partitions(n, most=None):
    if n == 0:
        yield []
    for k in range(min(n, most or n), 0, -1):
        yield from ([k, *rest] for rest in partitions(n - k, k))


def test_hook_lengths_count_fillings():
    for n in range(1, 9):
        for columns in partitions(n):
            rows = D.shape(np.array(columns))[1].tolist()
            assert sum(rows) == n and math.factorial(n) // math.prod(D.hooks(np.array(columns)).tolist()) == fillings(rows)
    bound = D.hook_bound(np.array([2] * 10), 20)
    assert abs(bound - math.log2(math.factorial(20) / math.prod(D.hooks(np.array([2] * 10)).tolist()))) < 0.01 and D.hook_bound(np.array([300]), 300) == 0.0


def test_interleaved_sequences():
    for k in range(2, 9):
        v = np.array([j * 1000 + i for i in range(60) for j in range(k)][: 60 * k])[::1]
        v = np.array([(k - 1 - j) * 1000 + i for i in range(60) for j in range(k)])
        p = D.classify(v)
        if 256 <= len(v):
            assert p["interleave"] == k == p["lds"]
        assert D.interleaved(D.piles(v), len(v)) == k
    assert D.interleaved(np.array([9, 1]), 10) == 0 and D.interleaved(np.array([5, 1, 1]), 7) == 0 and D.interleaved(np.array([2]), 2) == 0


def test_phase_boundary():
    down = np.concatenate([np.arange(300), [*range(900, 700, -1)], [*range(700, 500, -1)], [*range(2000, 1800, -1)]]).astype(float)
    p = D.classify(down)
    assert p["cls"] == "PHASED" and 280 < p["phase"] <= 300
    noise = np.random.default_rng(0).random(900)
    assert D.classify(noise)["cls"] == "RANDOM" and D.phase_boundary(np.arange(500.0)) == 0 and D.phase_boundary(down[:63]) == 0
    # A single window of falls is a spike: the energy it gives leaks away before it is released.
    spring, level = D.Oscillator(), [0.0, 0.4, 0.0, 0.0, 0.0]
    assert not any(spring.shifts(x) for x in level)
    spring = D.Oscillator()
    told = [spring.shifts(x) for x in [0.0] * 5 + [0.4] * 40]
    assert sum(told) == 1 and told.index(True) in (6, 7)


@pytest.mark.parametrize("v, cls", [([], "SORTED"), ([1], "SORTED"), ([1, 1, 1], "SORTED"), ([3, 2, 1], "REVERSED"), ([3, 4, 5, 1, 2], "NEARLY_SORTED"), ([1, 2, 0], "RANDOM"), ([1, 2] * 100, "FEW_UNIQUE")])
def test_small_classes(v, cls):
    assert D.classify(v)["cls"] == cls


def test_runs_row_by_row():
    r = np.random.default_rng(4)
    for _ in range(200):
        v = r.integers(0, 4, r.integers(2, 12)).astype(float)
        runs, mono, longest, length = 1, 1, 0, 1
        up = [b >= a for a, b in zip(v, v[1:])]
        for i, x in enumerate(up):
            runs += i > 0 and x and not up[i - 1]
            if i and x != up[i - 1]:
                mono, longest, length = mono + 1, max(longest, length), 1
            else:
                length += 1
        got = D.runs(v)
        assert (got["runs"], got["mono"], got["longest"]) == (runs, mono, max(longest, length)) and got["descent"] == max([0, *(a - b for a, b in zip(v, v[1:]))])


def test_recurrence_lines_one_by_one():
    r = np.random.default_rng(2)
    x = [0.3]
    for _ in range(199):
        x.append(3.99 * x[-1] * (1 - x[-1]))
    for v in (r.random(100), np.array(x), np.sin(np.arange(120) / 5)):
        m = len(v)
        d = sorted(abs(v[i] - v[j]) for i in range(m) for j in range(i + 1, m))
        near = d[int(0.1 * len(d))]
        on = count = 0
        for off in range(1, m):
            line = [abs(v[i] - v[i + off]) < near for i in range(m - off)]
            count += sum(line)
            on += sum(len(list(g)) for hit, g in itertools.groupby(line) if hit) - sum(1 for hit, g in itertools.groupby(line) if hit and len(list(g)) == 1)
        rate = count / len(d)
        chance = rate * (2 - rate)
        assert abs(D.recurrence_score(v) - min(1, 1 - max(0, (on / count - chance) / (1 - chance)))) < 1e-6
    assert D.recurrence_score(np.ones(100)) is None


def test_verdicts_by_kind_of_sequence():
    r = np.random.default_rng(0)
    noise = [D.randomness(r.random(1000)) for _ in range(5)]
    assert all(x["n"] == 8 and x["verdict"] in ("max-entropy", "consistent") for x in noise) and sum(x["verdict"] == "max-entropy" for x in noise) >= 3
    chaos = [0.3]
    for _ in range(999):
        chaos.append(3.99 * chaos[-1] * (1 - chaos[-1]))
    assert D.randomness(chaos)["recurrence"] < 0.5 < D.randomness(chaos)["hook"] and D.randomness(chaos)["verdict"] == "consistent"
    assert D.randomness(np.arange(300.0))["verdict"] == "structured" and D.randomness(np.arange(300.0))["confidence"] == 0
    assert D.randomness(r.integers(0, 3, 500))["spectral"] < 0.7 and D.randomness(np.sin(np.arange(600) / 9))["verdict"] == "mixed"
    assert D.randomness([])["verdict"] == D.randomness([1])["verdict"] == "structured"
    c = D.characterize(r.random(1000))
    assert c["cls"] == "RANDOM" and c["n"] == 1000 and c["info_bound"] > 3000 and c["rand_confidence"] > 0.7


def test_windows_of_the_known_sequence(spark):
    df = spark.createDataFrame(list(enumerate(LOC)), "at int, v int")
    got = W.locate_values(df.repartition(3), "v", ["at"], [], "SORTED", 4, 1)
    assert sorted(r.v for r in got.collect()) == [1, 2, 3, 4, 5, 6, 7, 8] and got.columns == ["at", "v", "n"]
    assert sorted(r.start for r in W.locate(df, "v", ["at"], [], "SORTED", 4, 1).collect()) == [0, 1, 2, 3, 4]
    assert W.profile(df, "v", ["at"], [], 13).count() == 0 and W.profile(df.limit(0), "v", ["at"], [], 4).count() == 0


@pytest.mark.parametrize("window, stride", [(8, 8), (16, 3), (40, 1), (5, 11)])
def test_windows_across_chunks(spark, monkeypatch, window, stride):
    monkeypatch.setattr(W, "CHUNK", 12)
    r = np.random.default_rng(1)
    rows = [(k, i, float(r.integers(0, 50)) if i % 40 > 20 else float(i)) for k, n in (("a", 200), (None, 90), ("c", 3)) for i in range(n)]
    rows += [("a", 17, None)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    got = W.profile(df, "v", ["i"], ["k"], window, stride, parts=4)
    want = []
    for k in ("a", None, "c"):
        v = [x[2] for x in sorted((x for x in rows if x[0] == k and x[2] is not None), key=lambda x: x[1])]
        want += [(k, a, D.classify(v[a : a + window])["cls"]) for a in range(0, len(v) - window + 1, stride)]
    assert sorted(((x.k, x.start, x.cls) for x in got.collect()), key=str) == sorted(want, key=str)
    covered = {(k, n) for k, a, c in want if c == "SORTED" for n in range(a, a + window)}
    values = W.locate_values(df, "v", ["i"], ["k"], "SORTED", window, stride, parts=4).select("k", "n").collect()
    assert len(values) == len(set(values)) and {(x.k, x.n) for x in values} == covered


def test_one_long_key_in_many_tasks(spark):
    n = 2_000_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 5000 < 2500, F.col("id")).otherwise(F.xxhash64("id") % 1000).cast("double").alias("v"))
    rows = W.numbered(df, ["id"], [], parts=16)
    assert rows.where("n <> id").count() == 0
    got = W.profile(df, "v", ["id"], [], 1000, parts=16)
    assert {(r.cls, r["count"]) for r in got.groupBy("cls").count().collect()} >= {("SORTED", 800)} and got.count() == 2000
    chunks, size = W.chunked(rows, 1000, 1000)
    most = chunks.groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= size + 999 and most[1] > 100


@pytest.mark.parametrize("m, block, tile", [(8, 40, 16), (5, 1000, 7), (20, 25, 1024)])
def test_matrix_profile_in_blocks(spark, monkeypatch, m, block, tile):
    from weir.functions import kernels as K

    monkeypatch.setattr(W, "BLOCK", block)
    monkeypatch.setattr(W, "TILE", tile)
    r = np.random.default_rng(7)
    series = {"a": r.normal(size=230), None: np.sin(np.arange(120) / 3) + r.normal(size=120) / 20, "flat": np.r_[np.zeros(40), r.normal(size=30)], "short": r.normal(size=m - 1), "one": r.normal(size=m)}
    df = spark.createDataFrame([(k, i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, i int, v double").repartition(4)
    got = {}
    for x in W.matrix_profile(df, "v", ["i"], ["k"], m, parts=3).collect():
        got.setdefault(x.k, {})[x.start] = (x.distance, x.nearest)
    for k in ("a", None, "flat"):
        best, _ = K.matrix_profile(series[k], m)
        u = W._unit(series[k], m)
        assert len(got[k]) == len(best)
        for s, (d, at) in got[k].items():
            assert abs(d - best[s]) < 1e-5 and abs(s - at) > max(1, m // 4) and abs(np.sqrt(((u[s] - u[at]) ** 2).sum()) - best[s]) < 1e-5
    assert "short" not in got and "one" not in got
    whole = W.matrix_profile(df.where("k = 'a'"), "v", ["i"], [], m)
    assert sorted((x.start, round(x.distance, 6)) for x in whole.collect()) == sorted((s, round(d, 6)) for s, (d, _) in got["a"].items())
