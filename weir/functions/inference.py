"""Two-sample inference on small samples, deterministic for a seed."""

from __future__ import annotations

import itertools
import math

import numpy as np

M64 = (1 << 64) - 1


def fnv1a(*parts: object) -> int:
    h = 0xCBF29CE484222325
    for b in "\x1f".join(map(str, parts)).encode():
        h = ((h ^ b) * 0x100000001B3) & M64
    return h


def cliffs_delta(a, b) -> tuple[float, str]:
    a, b = np.asarray(a, float), np.sort(np.asarray(b, float))
    if not len(a) or not len(b):
        return 0.0, "negligible"
    less = np.searchsorted(b, a, "left").sum()  # b below a
    more = len(a) * len(b) - np.searchsorted(b, a, "right").sum()
    d = float(less - more) / (len(a) * len(b))
    size = abs(d)
    return d, "negligible" if size < 0.147 else "small" if size < 0.33 else "medium" if size < 0.474 else "large"


def permutation_test(a, b, rounds: int = 2000, seed: int = 0) -> float:
    """Two-sided p of a difference of means: all splits where there are no more than rounds of them, else shuffles."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    pool, n = np.concatenate([a, b]), len(a)
    gap = abs(a.mean() - b.mean()) - 1e-12
    total = pool.sum()
    if math.comb(len(pool), n) <= rounds:
        hits = [abs(sum(s) / n - (total - sum(s)) / len(b)) >= gap for s in itertools.combinations(pool.tolist(), n)]
        return sum(hits) / len(hits)
    r = np.random.default_rng(seed & M64)
    s = np.array([r.permutation(pool)[:n].sum() for _ in range(rounds)])
    return float(((np.abs(s / n - (total - s) / len(b)) >= gap).sum() + 1) / (rounds + 1))


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = (d if abs(d) > 1e-300 else 1e-300), (c if abs(c) > 1e-300 else 1e-300)
            d = 1 / d
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def student_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if not math.isfinite(t):
        return 0.0 if t > 0 else 1.0
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))
    inc = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return inc / 2 if t > 0 else 1 - inc / 2


def welch(a, b) -> tuple[float, float, float]:
    """t, degrees of freedom and two-sided p."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if len(a) < 2 or len(b) < 2:
        return 0.0, 0.0, 1.0
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    if va + vb == 0:
        return (0.0, 1.0, 1.0) if a.mean() == b.mean() else (math.inf, 1.0, 0.0)
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    df = (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1))
    return float(t), float(df), 2 * student_sf(abs(t), df)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(Q > q) by quadrature over the range and the scale."""
    z = np.linspace(-8, 8, 401)
    pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)))
    s = np.linspace(1e-3, 1 + 8 / math.sqrt(2 * df), 161)
    log = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    dens = np.exp(log)
    big = cdf(z)
    inner = np.array([k * np.trapezoid(pdf * (big - cdf(z - q * x)) ** (k - 1), z) for x in s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(dens * inner, s))))


def games_howell(groups: dict[str, list[float]]) -> list[tuple[str, str, float]]:
    """(a, b, p) of each pair."""
    out = []
    for (x, a), (y, b) in itertools.combinations(sorted(groups.items()), 2):
        t, df, _ = welch(a, b)
        out.append((x, y, studentized_range_sf(abs(t) * math.sqrt(2), len(groups), df) if df and math.isfinite(t) else 1.0 if not t else 0.0))
    return out


def compare_with_best(groups: dict[str, list[float]], rounds: int = 2000, seed: int = 0) -> dict[str, tuple[float, float]]:
    """Bootstrap 95 % bounds of each group's mean less the best (smallest) other one's."""
    r = np.random.default_rng(seed & M64)
    names = sorted(groups)

    def means(x: np.ndarray) -> np.ndarray:
        step = max(1, 1_000_000 // len(x))  # rounds whose draws are held at once
        return np.concatenate([x[r.integers(0, len(x), (min(step, rounds - i), len(x)))].mean(axis=1) for i in range(0, rounds, step)])

    boot = {n: means(np.asarray(groups[n], float)) for n in names}
    return {n: tuple(np.quantile(boot[n] - np.min([boot[m] for m in names if m != n], axis=0), [0.025, 0.975])) for n in names} if len(names) > 1 else {}


def power(a, b, target: float = 0.8, rounds: int = 2000, most: int = 20, seed: int = 0) -> int:
    """The runs a side that Welch's t test needs to reach target power at a level of 0.05, by draws; 0 if most do not suffice."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if np.ptp(np.concatenate([a, b])) == 0:
        return 0
    r = np.random.default_rng(seed & M64)
    for n in range(2, most + 1):
        x, y = r.choice(a, (rounds, n)), r.choice(b, (rounds, n))
        vx, vy = x.var(axis=1, ddof=1) / n, y.var(axis=1, ddof=1) / n
        some = vx + vy > 0  # a draw without variance is no hit
        vx, vy = vx[some], vy[some]
        t = np.abs(x.mean(axis=1) - y.mean(axis=1))[some] / np.sqrt(vx + vy)
        df = (vx + vy) ** 2 / ((vx**2 + vy**2) / (n - 1))
        if sum(2 * student_sf(v, f) < 0.05 for v, f in zip(t.tolist(), df.tolist())) >= target * rounds:
            return n
    return 0


#: Levels up to which all their orders are tried.
EXACT_LEVELS = 7


def rank_scan(levels: list[list[float]]) -> tuple[float, float, int]:
    """Sum of squares and maximum of standardised rank statistics over the cuts of an ordered list of groups, and the best cut."""
    flat = np.concatenate([np.asarray(x, float) for x in levels])
    u, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n, tie = len(flat), (count**3 - count).sum()
    ends = np.cumsum([len(x) for x in levels])[:-1]
    t = []
    for e in ends:
        var = e * (n - e) / 12 * ((n + 1) - tie / (n * (n - 1))) if n > 1 else 0
        t.append((rank[:e].sum() - e * (n + 1) / 2) / math.sqrt(var) if var > 0 else 0.0)
    t = np.array(t)
    return float((t**2).sum()), float(np.abs(t).max()), int(np.abs(t).argmax()) + 1


def _scans(levels: list[list[float]], orders: np.ndarray) -> list[tuple[float, float]]:
    """rank_scan's sum and maximum for each order of the groups: ranks are those of all values, so only sums of groups are put in order."""
    flat = np.concatenate([np.asarray(x, float) for x in levels])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    n, tie = len(flat), (count**3 - count).sum()
    sizes = np.array([len(x) for x in levels])
    sums = np.add.reduceat(rank, np.cumsum(sizes) - sizes)
    ends, upto = np.cumsum(sizes[orders], axis=1)[:, :-1], np.cumsum(sums[orders], axis=1)[:, :-1]
    var = ends * (n - ends) / 12 * ((n + 1) - tie / (n * (n - 1))) if n > 1 else np.zeros_like(upto)
    t = np.where(var > 0, (upto - ends * (n + 1) / 2) / np.sqrt(np.where(var > 0, var, 1)), 0.0)
    return list(zip((t**2).sum(axis=1).tolist(), np.abs(t).max(axis=1).tolist()))


def trajectory(levels: list[list[float]], alpha: float = 0.05, effect: float = 0.147, rounds: int = 999, seed: int = 0, offset: int = 0) -> list[int]:
    """Places where an ordered list of groups changes: a scan tested against orders of the groups, then either side."""
    if len(levels) < 2:
        return []
    dense, sparse, cut = rank_scan(levels)
    orders = list(itertools.permutations(range(len(levels)))) if len(levels) <= EXACT_LEVELS else None
    r = np.random.default_rng((seed + offset) & M64)
    draws = _scans(levels, np.array(orders if orders else [r.permutation(len(levels)) for _ in range(rounds)]))
    plus = 0 if orders else 1
    p = min((sum(d >= dense - 1e-12 for d, _ in draws) + plus) / (len(draws) + plus), (sum(s >= sparse - 1e-12 for _, s in draws) + plus) / (len(draws) + plus))
    left, right = (np.concatenate([np.asarray(x, float) for x in part]) for part in (levels[:cut], levels[cut:]))
    if min(1.0, 2 * p) > alpha or abs(cliffs_delta(left, right)[0]) < effect:
        return []
    return [*trajectory(levels[:cut], alpha, effect, rounds, seed, offset), offset + cut, *trajectory(levels[cut:], alpha, effect, rounds, seed, offset + cut)]


def level_pairs(levels, mode: str):
    """(a, b, change) of the chosen pairs of levels (level, mean), in order of level: adjacent ones, all, or each against the best (of smallest mean). Levels are versions or days, so few."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.orderBy("level")
    numbered = levels.select("level", "mean", F.row_number().over(w).alias("place"))
    if mode == "adjacent":
        before = numbered.select(F.lag("level").over(w).alias("a"), F.col("level").alias("b"), F.round(F.col("mean") - F.lag("mean").over(w), 6).alias("change"))
        return before.where("a is not null")
    other = numbered.select(F.collect_list(F.struct("place", "level", "mean")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("others"), F.col("place").alias("at"), F.col("level").alias("from"), F.col("mean").alias("was"))
    if mode == "vs_best":
        other = other.orderBy("was", "at").limit(1)
    each = other.select("at", "from", "was", F.explode("others").alias("o")).where("o.place > at" if mode == "all" else "o.place <> at")
    return each.select(F.col("from").alias("a"), F.col("o.level").alias("b"), F.round(F.col("o.mean") - F.col("was"), 6).alias("change"))
