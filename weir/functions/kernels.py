"""Numeric kernels over one array or matrix at a time, for grouped maps: anomaly, graph and signal; those of disorder are in disorder.py."""

from __future__ import annotations

import math

import numpy as np

from weir.functions.disorder import classify, distinct_estimate, lis_length, permutation_entropy, randomness, sampled_inversions, visibility_degree  # noqa: F401

M64 = (1 << 64) - 1


def splitmix64(state: int):
    """Endless 64-bit numbers."""
    while True:
        state = (state + 0x9E3779B97F4A7C15) & M64
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M64
        yield z ^ (z >> 31)


# -- anomaly ----------------------------------------------------------------


def standardize(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=0)
    return np.where(sd > 0, (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), 0.0)


def mad_scores(x: np.ndarray) -> np.ndarray:
    """Largest robust z of each row; a column without a MAD falls back to its mean absolute deviation."""
    off = np.abs(x - np.median(x, axis=0))
    mad, mean = np.median(off, axis=0), off.mean(axis=0)
    scale = np.where(mad > 0, mad / 0.6745, 1.2533 * mean)
    return np.where(scale > 0, off / np.where(scale > 0, scale, 1), 0).max(axis=1)


def mahalanobis(x: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Squared distances under the population covariance with a ridge."""
    d = x - x.mean(axis=0)
    cov = d.T @ d / len(x) + ridge * np.eye(x.shape[1])
    low = np.linalg.cholesky(cov)
    return (np.linalg.solve(low, d.T) ** 2).sum(axis=0)


def half_space_trees(x: np.ndarray, trees: int = 25, depth: int = 12, window: int = 200, limit: int = 25, seed: int = 1729) -> np.ndarray:
    """Mass of each row's leaf in the window before (small: unusual), rows in stream order."""
    lo, hi = x.min(axis=0), x.max(axis=0)
    span = np.where(hi > lo, hi - lo, 1)
    u = (x - lo) / span
    r = splitmix64(seed)
    out = np.zeros(len(x))
    for _ in range(trees):
        a = np.zeros(x.shape[1])
        b = np.ones(x.shape[1])
        for j in range(x.shape[1]):  # a working range about a random point, as wide as twice its farther side
            s = next(r) / 2**64
            w = 2 * max(s, 1 - s)
            a[j], b[j] = s - w, s + w
        node = np.zeros(len(x), np.int64)
        low, high = np.tile(a, (len(x), 1)), np.tile(b, (len(x), 1))
        paths = [node.copy()]
        axes: dict[int, int] = {}
        for _ in range(depth):
            for k in np.unique(node):
                if k not in axes:
                    axes[k] = next(r) % x.shape[1]
            axis = np.array([axes[k] for k in node.tolist()])
            row = np.arange(len(x))
            mid = (low[row, axis] + high[row, axis]) / 2
            right = u[row, axis] >= mid
            low[row, axis] = np.where(right, mid, low[row, axis])
            high[row, axis] = np.where(right, high[row, axis], mid)
            node = 2 * node + 1 + right
            paths.append(node.copy())
        for start in range(0, len(x), window):
            ref = slice(0, window) if start == 0 else slice(start - window, start)
            mass = [dict(zip(*np.unique(p[ref], return_counts=True))) for p in paths]
            for i in range(start, min(start + window, len(x))):
                for level, p in enumerate(paths):
                    m = int(mass[level].get(p[i], 0))
                    if m <= limit or level == depth:
                        out[i] += m * 2.0**level
                        break
    return out


def tied_rank(v: np.ndarray) -> np.ndarray:
    """Ranks from 0 to 1, ties averaged."""
    if len(v) < 2:
        return np.zeros(len(v))
    u, inverse, count = np.unique(v, return_inverse=True, return_counts=True)
    before = np.cumsum(count) - count
    return (before + (count - 1) / 2)[inverse] / (len(v) - 1)


def anomaly_fuse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the three detectors' ranks, and the column of the largest z; constant columns take no part."""
    live = np.flatnonzero(x.std(axis=0) > 0)
    if not len(live):
        return np.zeros(len(x)), np.zeros(len(x), int)
    z = standardize(x[:, live])
    score = (tied_rank(mad_scores(z)) + tied_rank(mahalanobis(z)) + tied_rank(-half_space_trees(z))) / 3
    return score, live[np.abs(z).argmax(axis=1)]


def ewma_residual(v: np.ndarray, alpha: float) -> np.ndarray:
    level, var, out = v[0], 0.0, np.zeros(len(v))
    for i in range(1, len(v)):
        d = v[i] - level
        out[i] = abs(d) / math.sqrt(var) if var > 0 else 0.0
        level += alpha * d
        var = (1 - alpha) * (var + alpha * d * d)
    return out


def changepoint(v: np.ndarray, fast: float = 0.4, slow: float = 0.06) -> float:
    """Divergence of a fast and a slow average in standard deviations; 0 below eight values."""
    if len(v) < 8:
        return 0.0
    a = b = float(v[0])
    for x in v[1:]:
        a += fast * (x - a)
        b += slow * (x - b)
    sd = float(np.std(v))
    return abs(a - b) / sd if sd > 0 else 0.0


# -- graphs -----------------------------------------------------------------


def affinity(x: np.ndarray, knn: int = 7) -> np.ndarray:
    """Self-tuning affinities: each row's scale is its distance to the knn-th neighbour."""
    d = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2), 0))
    s = np.sort(d, axis=1)[:, min(knn, len(x) - 1)]
    w = np.exp(-(d**2) / np.maximum(np.outer(s, s), 1e-12))
    np.fill_diagonal(w, 0)
    return w


def laplacian(w: np.ndarray) -> np.ndarray:
    return np.diag(w.sum(axis=1)) - w


def effective_resistance(w: np.ndarray) -> np.ndarray:
    p = np.linalg.pinv(laplacian(w), hermitian=True)
    d = np.diag(p)
    return d[:, None] + d[None, :] - 2 * p


def fiedler(w: np.ndarray) -> tuple[float, int]:
    """Algebraic connectivity, and the number of parts by the largest gap among small eigenvalues."""
    e = np.linalg.eigvalsh(laplacian(w))
    gaps = np.diff(e[: max(2, min(len(e), 10))])
    return float(e[1]) if len(e) > 1 else 0.0, int(np.argmax(gaps)) + 1 if len(gaps) else 1


def spectral_cluster(w: np.ndarray, k: int, seed: int = 1729) -> np.ndarray:
    """Labels by k-means on the rows of the normalised Laplacian's first eigenvectors."""
    d = 1 / np.sqrt(np.maximum(w.sum(axis=1), 1e-12))
    _, v = np.linalg.eigh(np.eye(len(w)) - d[:, None] * w * d[None, :])
    u = v[:, :k]
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    r = splitmix64(seed)
    centres = [u[next(r) % len(u)]]
    while len(centres) < k:
        gap = np.min([((u - c) ** 2).sum(axis=1) for c in centres], axis=0)
        total = gap.sum()
        at = np.searchsorted(np.cumsum(gap), next(r) / 2**64 * total) if total > 0 else next(r) % len(u)
        centres.append(u[min(int(at), len(u) - 1)])
    c = np.array(centres)
    for _ in range(100):
        label = ((u[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([u[label == j].mean(axis=0) if (label == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return label


# -- signals ----------------------------------------------------------------


def spectral_residual(v: np.ndarray, q: int = 3, tau: float = 3.0, z: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Saliency of each sample and whether it exceeds the mean of the z before it by tau times; a power of two of samples."""
    n = len(v)
    if n < 4 or n & (n - 1):
        raise ValueError("a power of two of samples is needed")
    f = np.fft.fft(v)
    log = np.log(np.abs(f) + 1e-12)
    smooth = np.convolve(np.pad(log, q // 2, mode="wrap"), np.ones(q) / q, "valid")[:n]
    sal = np.abs(np.fft.ifft(np.exp(log - smooth + 1j * np.angle(f))))
    z = z or max(1, n // 4)
    c = np.concatenate([[0], np.cumsum(sal)])
    at = np.arange(n)
    lo = np.maximum(at - z, 0)
    mean = np.where(at > lo, (c[at] - c[lo]) / np.maximum(at - lo, 1), sal)
    return sal, (sal - mean) > tau * np.maximum(mean, 1e-12)


def matrix_profile(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and place of each window's nearest other window, z-normalised, windows within m / 4 excluded."""
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(v, float), m)
    sd = w.std(axis=1, keepdims=True)
    x = np.where(sd > 1e-12, (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), 0)
    k = len(x)
    best, at = np.full(k, np.inf), np.full(k, -1)
    skip = max(1, m // 4)
    for i in range(k):
        d = np.sqrt(np.maximum(((x - x[i]) ** 2).sum(axis=1), 0))
        d[max(0, i - skip) : i + skip + 1] = np.inf
        at[i] = int(d.argmin())
        best[i] = d[at[i]]
    return best, at


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, intercept and the slope's standard error."""
    n = len(x)
    dx = x - x.mean()
    sxx = (dx**2).sum()
    if n < 2 or sxx == 0:
        return 0.0, float(y.mean()) if n else 0.0, 0.0
    b = float((dx * (y - y.mean())).sum() / sxx)
    a = float(y.mean() - b * x.mean())
    err = float(((y - a - b * x) ** 2).sum())
    return b, a, math.sqrt(err / (n - 2) / sxx) if n > 2 else 0.0


def _scales(n: int, least: int = 8) -> list[int]:
    top = n // 4
    return sorted({int(round(least * (top / least) ** (i / 15))) for i in range(16)}) if top > least else []


def hurst_dfa(v: np.ndarray) -> tuple[float, float]:
    """Exponent and standard error by detrended fluctuation analysis; 0.5 where there are too few scales."""
    y = np.cumsum(np.asarray(v, float) - np.mean(v))
    xs, fs = [], []
    for s in _scales(len(y)):
        seg = y[: len(y) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        flat = seg - seg.mean(axis=1, keepdims=True)
        slope = flat @ t / (t @ t)
        f = np.sqrt(((flat - slope[:, None] * t) ** 2).mean())
        if f > 0:
            xs.append(math.log(s)), fs.append(math.log(f))
    if len(xs) < 3:
        return 0.5, 0.0
    b, _, se = least_squares(np.array(xs), np.array(fs))
    return b, se


def hurst_rs(v: np.ndarray) -> float:
    xs, rs = [], []
    v = np.asarray(v, float)
    for s in _scales(len(v)):
        seg = v[: len(v) // s * s].reshape(-1, s)
        dev = np.cumsum(seg - seg.mean(axis=1, keepdims=True), axis=1)
        sd = seg.std(axis=1)
        ok = sd > 0
        if ok.any():
            xs.append(math.log(s)), rs.append(math.log(((dev.max(axis=1) - dev.min(axis=1))[ok] / sd[ok]).mean()))
    return least_squares(np.array(xs), np.array(rs))[0] if len(xs) >= 3 else 0.5
