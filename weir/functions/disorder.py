"""How a sequence is disordered: its runs, its tableau, where a phase ends, its class, and how random it looks.

Single precision is used where results are defined by it.
"""

from __future__ import annotations

import bisect
import math

import numpy as np

M64 = (1 << 64) - 1
#: Fixed values. Pairs and values that are sampled; sizes between which the tableau is made, and its largest rows and columns.
PAIRS, DISTINCT, LEAST, MOST, WIDEST = 128, 64, 256, 10_000, 256
#: Windows of a phase's end and the step between them; spring, damping, slack, and the leak, park and release levels of the energy.
PHASE, PHASE_STEP = 32, 16
SPRING, DAMPING, SLACK, LEAK, PARK, RELEASE = (np.float32(x) for x in (0.0078125, 0.125, 0.25, 0.125, 0.125, 0.25))
#: Score from which a lens agrees; window, least length and recurrence rate of recurrence lines; vertices and level of the comparison graph.
AGREES, RQA_WINDOW, RQA_LEAST, RQA_RATE, VERTICES, FLAT = 0.70, 512, 64, 0.10, 64, 0.05
#: Ordinal pattern of three values by a < b (4), b < c (2), a < c (1).
PATTERNS = np.array([5, 0, 4, 3, 2, 1, 0, 0])
LENSES = ("hook", "lis", "inversion", "distinct", "visibility", "ordinal", "recurrence", "spectral")
F32 = np.float32


def lcg(seed: int, n: int, count: int) -> list[int]:
    """count indices below n, from a 64-bit linear congruential generator."""
    s, out = seed & M64, []
    for _ in range(count):
        s = (s * 6364136223846793005 + 1442695040888963407) & M64
        out.append((s >> 33) % n)
    return out


def sampled_pairs(n: int, pairs: int = PAIRS) -> list[tuple[int, int]]:
    """The pairs (a <= b) of n places that inversions are sampled at."""
    total = min(pairs, n * (n - 1) // 2)
    at = lcg(0x5DEECE66D ^ n, n, 2 * total)
    return [(min(a, b), max(a, b)) for a, b in zip(at[::2], at[1::2])]


def sampled_inversions(v: np.ndarray, pairs: int = PAIRS) -> float:
    """Share of sampled pairs that are out of order; the sample depends on the length alone."""
    n = len(v)
    if n < 2:
        return 0.0
    at = np.array(sampled_pairs(n, pairs))
    total = len(at)
    v = np.asarray(v)
    return float(F32((v[at[:, 0]] > v[at[:, 1]]).sum()) / F32(total))


def distinct_estimate(v: np.ndarray) -> int:
    """Distinct values among 64 evenly placed ones, scaled to all."""
    n = len(v)
    m = min(n, DISTINCT)
    if not m:
        return 0
    return min(len(np.unique(np.asarray(v)[: n // m * m : n // m][:m])) * n // m, n)


def runs(v: np.ndarray) -> dict:
    """runs: stretches that a rise after a fall begins; mono: stretches that rise (or stay) or fall throughout; longest of the latter; steepest fall."""
    falls = v[1:] < v[:-1]
    if not len(falls):
        return {"runs": 1, "mono": 1, "longest": 1, "descent": 0.0}
    turns = np.flatnonzero(falls[1:] != falls[:-1])
    lengths = np.diff(np.concatenate([[-1], turns, [len(falls) - 1]]))
    lengths[0] += 1
    return {"runs": 1 + int((falls[:-1] & ~falls[1:]).sum()), "mono": len(lengths), "longest": int(lengths.max()), "descent": float(np.where(falls, v[:-1] - v[1:], 0).max())}


def piles(v) -> np.ndarray:
    """Sizes of the piles of patience sorting, a card on the leftmost pile whose top is not below it: as many piles as the longest increasing subsequence is long."""
    tops: list[float] = []
    sizes: list[int] = []
    for x in np.asarray(v).tolist():
        k = bisect.bisect_left(tops, x)
        if k == len(tops):
            tops.append(x)
            sizes.append(1)
        else:
            tops[k] = x
            sizes[k] += 1
    return np.array(sizes, np.int64)


def lis_length(v) -> int:
    """Longest non-decreasing subsequence, by patience sorting."""
    tops: list[float] = []
    for x in v:
        k = bisect.bisect_right(tops, x)
        tops[k : k + 1] = [x]
    return len(tops)


def shape(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns in falling order and the rows of their diagram."""
    columns = np.sort(columns)[::-1]
    return columns, (columns[None, :] > np.arange(columns[0])[:, None]).sum(axis=1)


def log2_factorial(n: int) -> float:
    """By Stirling's formula."""
    return n * math.log2(n) - n * 1.4426950408889634 + 0.5 * math.log2(2 * math.pi * n) if n > 1 else 0.0


def hooks(columns: np.ndarray) -> np.ndarray:
    """Of each cell of the diagram: itself, those right of it and those below it."""
    columns, rows = shape(columns)
    i, j = np.ogrid[: len(rows), : len(columns)]
    return ((rows[:, None] - j) + (columns[None, :] - i) - 1)[j < rows[:, None]]


def hook_bound(columns: np.ndarray, n: int) -> float:
    """log2 of the number of standard fillings of the diagram (hook lengths, factorial by Stirling); 0 where it is too wide or too high."""
    if n <= 1 or len(columns) > WIDEST or columns.max() > WIDEST:
        return 0.0
    return float(F32(max(log2_factorial(n) - np.log2(hooks(columns)).sum(), 0.0)))


def interleaved(columns: np.ndarray, n: int) -> int:
    """The number of sorted sequences, 2 to 8, that n values seem to be dealt from: rows of the diagram, none more than twice as long as another; else 0."""
    k = int(columns.max())
    if not 2 <= k <= 8 or n < 2 * k:
        return 0
    _, rows = shape(columns[:WIDEST])
    return k if len(rows) == k and rows.max() <= 2 * rows.min() else 0


class Oscillator:
    """A damped spring drawn to each sample. A sample far off or a fast spring feeds a leaking store of energy; when that passes the release level a shift is told, once until it has sunk below the park level."""

    def __init__(self):
        self.at, self.speed, self.energy, self.told = None, F32(0), F32(0), False

    def shifts(self, sample: float) -> bool:
        x = F32(sample)
        if self.at is None:
            self.at = x
            return False
        off = x - self.at
        self.speed = self.speed + off * SPRING
        self.speed = self.speed - self.speed * DAMPING
        self.at = self.at + self.speed
        fed = off * off if abs(off) > SLACK else F32(0)
        self.energy = (self.energy - self.energy * LEAK) + (fed + self.speed * self.speed)
        if self.told:
            self.told = bool(self.energy >= PARK)
            return False
        self.told = bool(self.energy > RELEASE)
        return self.told


def phase_boundary(v: np.ndarray) -> int:
    """Where the share of falls in overlapping windows shifts first; 0 if nowhere. The first window, to which the spring is set, begins at PHASE."""
    n = len(v)
    if n < 2 * PHASE:
        return 0
    falls = np.concatenate([[0], np.cumsum(v[1:] < v[:-1])])
    spring = Oscillator()
    for a in range(PHASE, n - 1, PHASE_STEP):
        b = min(a + PHASE, n)
        if spring.shifts(F32(falls[b - 1] - falls[a]) / F32(b - a - 1)):
            return a
    return 0


def classify(v) -> dict:
    """The class of a sequence and what it rests on.

    cls, runs, mono, longest, inversion, distinct, phase (where a sorted beginning ends, or 0), rotation, lis (an estimate
    from the inversions; exact for 256 to 10,000 values, as lds, bound and interleave are, which else are 0).
    """
    v = np.asarray(v, float)
    n = len(v)
    p = {"cls": "SORTED", "runs": 1, "mono": 1, "longest": n, "inversion": 0.0, "lis": n, "lds": n, "distinct": n, "phase": 0, "rotation": 0, "bound": 0.0, "interleave": 0}
    if n <= 1:
        return p
    p |= {k: x for k, x in runs(v).items() if k != "descent"} | {"distinct": distinct_estimate(v)}
    falls = np.flatnonzero(v[1:] < v[:-1])
    if not len(falls):
        same = v[0] == v[-1]
        p |= {"lds": n if same else 1, "distinct": 1 if same else p["distinct"]}
    elif len(falls) == n - 1:
        p |= {"cls": "REVERSED", "lis": 1, "lds": n, "inversion": 1.0}
    elif p["runs"] == 2 and len(falls) == 1 and v[-1] <= v[0]:
        at = int(falls[0]) + 1
        p |= {"cls": "NEARLY_SORTED", "lis": n - 1, "lds": 2, "rotation": at, "inversion": float(F32(2.0 * at * (n - at) / (n * (n - 1.0))))}
    else:
        inversion = F32(sampled_inversions(v))
        p |= {"inversion": float(inversion), "lis": max(int((F32(1) - inversion) * F32(n)), 1), "lds": 0}
        if p["runs"] <= n // 4 and p["runs"] < n // 8 and p["longest"] > n // 2:
            p |= {"cls": "NEARLY_SORTED", "lis": p["longest"]}
        elif inversion < F32(0.05) and p["runs"] <= n // 16:
            p |= {"cls": "NEARLY_SORTED", "lis": n - int(inversion * F32(n))}
        elif p["distinct"] <= n // 4:
            p["cls"] = "FEW_UNIQUE"
        else:
            end = phase_boundary(v)
            if end and falls[0] + 1 >= end:
                p |= {"cls": "PHASED", "phase": end}
            else:
                p["cls"] = "NEARLY_SORTED" if p["lis"] > n * 3 // 4 else "RANDOM"
    if LEAST <= n <= MOST:
        columns = piles(v)
        p |= {"lis": len(columns), "lds": int(columns.max()), "bound": hook_bound(columns, n), "interleave": interleaved(columns, n)}
    return p


# -- lenses -----------------------------------------------------------------


def visibility_degree(v: np.ndarray) -> float:
    """Mean degree of the horizontal visibility graph; 4 for a random sequence."""
    edges, stack = 0, []
    for x in v:
        while stack and stack[-1] < x:
            stack.pop()
            edges += 1
        if stack:
            edges += 1
            if stack[-1] == x:
                stack.pop()
        stack.append(x)
    return 2 * edges / len(v)


def permutation_entropy(v: np.ndarray) -> float:
    """Normalised entropy of the ordinal patterns of three values in a row."""
    if len(v) < 3:
        return 0.0
    a, b, c = v[:-2], v[1:-1], v[2:]
    p = np.bincount(PATTERNS[(a < b) * 4 + (b < c) * 2 + (a < c)]) / (len(v) - 2)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / math.log2(6)) + 0.0


def recurrence_score(v: np.ndarray) -> float | None:
    """1 where recurrences of the first values stand on diagonal lines no more often than by chance, 0 where all do.

    Two values recur if closer than a tenth of all pairs are; a recurrence is on a line if a neighbour on its diagonal is
    one too, which by chance has probability rate * (2 - rate). None where more than that tenth are equal.
    """
    s = np.asarray(v, float)[:RQA_WINDOW]
    m = len(s)
    d = np.abs(s[:, None] - s[None, :])
    pairs = np.sort(d[np.triu_indices(m, 1)])
    near = pairs[int(RQA_RATE * len(pairs))] if len(pairs) else 0.0
    if not near > 0:
        return None
    r = np.triu(d < near, 1)
    beside = np.zeros_like(r)
    beside[1:, 1:] |= r[:-1, :-1]
    beside[:-1, :-1] |= r[1:, 1:]
    count = int(r.sum())
    rate = count / len(pairs)
    chance = rate * (2.0 - rate)
    if not count or chance >= 1:
        return None
    excess = ((r & beside).sum() / count - chance) / (1.0 - chance)
    return float(np.clip(F32(1) - F32(max(excess, 0.0)), 0, 1))


def comparison_graph(s: np.ndarray, seed: int) -> np.ndarray:
    """Laplacian of a graph on positions: each with a few evenly placed ones and a few drawn ones, edges weighing less the farther their values are apart."""
    n = len(s)
    hubs = np.minimum(np.arange(min((n.bit_length() + 1) // 2, n)) * max(n // min((n.bit_length() + 1) // 2, n), 1), n - 1)
    drawn = np.array(lcg(seed ^ 0x5DEECE66D, n, n * n.bit_length())).reshape(n, -1)
    edge = np.zeros((n, n), bool)
    edge[:, hubs] = True
    edge[np.arange(n)[:, None], drawn] = True
    edge = (edge | edge.T) & ~np.eye(n, dtype=bool)
    far = np.abs(s[:, None] - s[None, :]) / max(s.max() - s.min(), 1.0)
    w = np.where(edge, 1.0 / (1.0 + far * n), 0.0)
    return np.diag(w.sum(axis=1)) - w


def spectral_score(v: np.ndarray) -> float | None:
    """How well connected the comparison graph of 64 evenly placed values is for its largest eigenvalue; low where values cluster."""
    v = np.asarray(v, float)
    m = min(len(v), VERTICES)
    s = v[: len(v) // m * m : len(v) // m][:m]
    span = s.max() - s.min()
    grid = np.trunc((s - s.min()) / span * 1e9) if span > 0 else np.zeros(m)
    ev = np.linalg.eigvalsh(comparison_graph(grid, 0x12345678 ^ m))
    return float(np.clip(F32(ev[1] / ev[-1] / FLAT), 0, 1)) if ev[-1] > 1e-8 else None


def lenses(v) -> dict[str, float | None]:
    """Scores from 0 (structure) to 1 (random) by lens; None where a lens has too few or too many values to see by."""
    v = np.asarray(v, float)
    n, p = len(v), classify(v)
    clip = lambda x: float(np.clip(F32(x), 0, 1))
    tableau = LEAST <= n <= MOST
    expected = 2.0 * math.sqrt(n)
    return {
        "hook": clip(2.0 * p["bound"] / log2_factorial(n)) if tableau and p["bound"] > 0 else None,
        "lis": clip(1.0 - abs(p["lis"] - expected) / expected) if tableau else None,
        "inversion": clip(F32(1) - F32(2) * abs(F32(p["inversion"]) - F32(0.5))),
        "distinct": clip(p["distinct"] / n),
        "visibility": clip((visibility_degree(v) - 2.0) / 2.0),
        "ordinal": clip(permutation_entropy(v)),
        "recurrence": recurrence_score(v) if n >= RQA_LEAST else None,
        "spectral": spectral_score(v) if n >= VERTICES else None,
    }


def randomness(v) -> dict:
    """The lenses, how many there are (n) and agree (k), verdict and confidence: the least score, less 2^-k of it. Fewer than two values have no lens."""
    seen = lenses(v) if len(v) > 1 else dict.fromkeys(LENSES)
    known = [F32(x) for x in seen.values() if x is not None]
    n, k = len(known), sum(bool(x >= F32(AGREES)) for x in known)
    verdict = "structured" if not n else "max-entropy" if k == n else "consistent" if k + 1 >= n else "mixed" if k >= n // 2 else "structured"
    return {**seen, "n": n, "k": k, "verdict": verdict, "confidence": float((F32(1) - F32(2.0**-k)) * min(known)) if n else 0.0}


def characterize(v) -> dict:
    """Class, confidence that the sequence is random, length and the bound in bits (0: not measured) on telling its order."""
    p = classify(v)
    return {"cls": p["cls"], "rand_confidence": randomness(v)["confidence"], "n": len(v), "info_bound": p["bound"]}
