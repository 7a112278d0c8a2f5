import math

import numpy as np
import pytest

from weir.functions import inference as I
from weir.functions import kernels as K

NUMS = [5, 3, 8, 1, 9, 2, 7, 4, 6, 0, 3, 8]


def test_classify():
    got = K.classify(NUMS)
    assert (got["cls"], got["runs"], round(got["inversion"], 3), got["lis"], got["distinct"]) == ("RANDOM", 6, 0.515, 5, 10)
    assert K.classify(range(50))["cls"] == "SORTED" and K.classify(range(50, 0, -1))["cls"] == "REVERSED"
    assert K.classify([*range(20, 60), *range(20)])["cls"] == "NEARLY_SORTED" and K.classify([1, 2] * 100)["cls"] == "FEW_UNIQUE"
    assert K.lis_length([3, 1, 2, 2, 5, 4]) == 4


def test_randomness():
    r = np.random.default_rng(0)
    assert K.randomness(r.random(512))["k"] > K.randomness(np.arange(512.0))["k"]
    assert abs(K.visibility_degree(r.random(4000)) - 4) < 0.1 and K.permutation_entropy(r.random(4000)) > 0.99


def test_anomaly_finds_the_planted_row():
    x = np.random.default_rng(1).normal(size=(300, 4))
    x[77] = [9, -9, 8, 0]
    assert K.mad_scores(x).argmax() == K.mahalanobis(x).argmax() == 77
    assert K.anomaly_fuse(np.column_stack([x, np.ones(300)]))[0].argmax() == 77
    d = x - x.mean(axis=0)
    assert np.allclose(K.mahalanobis(x), [v @ np.linalg.inv(d.T @ d / 300 + 1e-3 * np.eye(4)) @ v for v in d])


def test_graph():
    r = np.random.default_rng(2)
    x = np.vstack([r.normal(c, 0.1, (20, 2)) for c in (0, 5)])
    label = K.spectral_cluster(K.affinity(x), 2)
    assert len(set(label[:20])) == len(set(label[20:])) == 1 and label[0] != label[20]
    path = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0.0]])
    assert np.allclose(K.effective_resistance(path)[0], [0, 1, 2]) and math.isclose(K.fiedler(path)[0], 1)


def test_signal():
    v = np.sin(np.arange(128) / 3)
    v[60:64] += 4
    assert abs(int(K.matrix_profile(v, 8)[0].argmax()) - 58) <= 8
    sal, _ = K.spectral_residual(v)
    assert 55 <= sal.argmax() <= 68
    noise = np.random.default_rng(3).normal(size=4096)
    assert abs(K.hurst_dfa(noise)[0] - 0.5) < 0.1 and K.hurst_dfa(np.cumsum(noise))[0] > 1.2


def test_inference():
    a, b = [1.0, 2, 3, 4], [3.0, 4, 5, 9]
    d = np.mean([[np.sign(x - y) for y in b] for x in a])
    assert math.isclose(I.cliffs_delta(a, b)[0], d) and I.cliffs_delta(a, a)[0] == 0
    assert I.permutation_test(a, a) == 1 and I.permutation_test([1, 1.1, 0.9, 1], [5, 5.1, 4.9, 5]) < 0.05
    assert math.isclose(2 * I.student_sf(2.228, 10), 0.05, abs_tol=1e-3)
    assert math.isclose(I.studentized_range_sf(3.877, 3, 10), 0.05, abs_tol=3e-3)
    assert math.isclose(I.welch([1, 2, 3, 4.0], [2, 4, 6, 8.0])[2], 0.1411, abs_tol=0.02)
    r = np.random.default_rng(4)
    levels = [list(r.normal(100 if i < 5 else 150, 2, 3)) for i in range(10)]
    assert I.trajectory(levels) == [5] and I.trajectory([list(r.normal(50, 1, 3)) for _ in range(10)]) == []


@pytest.mark.parametrize("n", [1, 3, 7])
def test_short_inputs(n):
    v = np.arange(float(n))
    K.classify(v), K.randomness(v), K.hurst_dfa(v), K.hurst_rs(v), K.changepoint(v)
