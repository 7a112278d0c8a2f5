"""Quality classifier: Bradley-Terry scores from preference pairs.

A text becomes FEATURES numbers (shares of character classes, word and line statistics, all over the whole text).
Labelled rows of the training folds, up to SAMPLE of them chosen by a hash, give preference pairs: each good text
against PAIRS bad ones. A text's strength is linear in its features; the probability that one text is preferred is
the logistic function of the difference of strengths, fitted by Newton steps under a small penalty. A quantile of
the training texts' strengths is the threshold; scores map it to CUT.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import wordhash as W
from weir.session import bound_batches, table

#: Labelled rows that training takes at most (a documented bound), pairs for each good one, penalty, and the score of the threshold.
SAMPLE, PAIRS, PENALTY, CUT = 20_000, 8, 1e-3, 0.7
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".", ",", "!?", "*#$%&@~^", "<>{}[]|\\/=_", "()'\"`;:-+")
FEATURES = len(_CLASSES) + 16


def _table() -> np.ndarray:
    t = np.full(256, len(_CLASSES), np.uint8)
    t[128:] = len(_CLASSES) + 1
    for k, chars in enumerate(_CLASSES):
        t[np.frombuffer(chars.encode(), np.uint8)] = k
    return t


_CLASS = _table()


def features(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), FEATURES))
    offs = W.text_buffers(column)[1]
    for lo, hi in W.chunks(offs):
        data, off = W.text_buffers(column.slice(lo, hi - lo))
        h, starts, ends, wo = W.words(data, off)
        kind = _CLASS[data]
        for i in range(hi - lo):
            n, w = off[i + 1] - off[i], h[wo[i] : wo[i + 1]]
            c = np.bincount(kind[off[i] : off[i + 1]], minlength=len(_CLASSES) + 2) / max(n, 1)
            row = out[lo + i]
            row[: len(c)] = np.sqrt(c)
            row = row[len(c) :]
            row[0] = np.log1p(n)
            if not len(w):
                continue
            size = (ends[wo[i] : wo[i + 1]] - starts[wo[i] : wo[i + 1]]).astype(float)
            _, times = np.unique(w, return_counts=True)
            end_kind, first_kind = kind[ends[wo[i] : wo[i + 1]] - 1], kind[starts[wo[i] : wo[i + 1]]]
            lines = bytes(data[off[i] : off[i + 1]]).split(b"\n")
            full = [x for x in lines if x.strip()]
            row[1] = np.log1p(len(w))
            row[2] = size.mean() / 10
            row[3] = size.std() / 10
            row[4] = len(times) / len(w)
            row[5] = times.max() / len(w)
            row[6] = (end_kind == 8).mean()
            row[7] = (end_kind == 7).mean()
            row[8] = (first_kind == 1).mean()
            row[9] = len(set(full)) / max(len(full), 1)
            row[10] = np.log1p(len(full))
            row[11] = (size > 20).mean()
            row[12] = (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
            row[13] = len(times) / np.sqrt(len(w)) / 10
    return out


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their squares."""
    return np.hstack([x, x * x])


class Ranker:
    """Strengths of texts: weights of standardised features, a threshold and a scale."""

    def __init__(self, mean, sd, weights, threshold, scale):
        self.mean, self.sd, self.weights, self.threshold, self.scale = mean, sd, weights, threshold, scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((expand(x) - self.mean) / self.sd, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.strength(x) - self.threshold) / self.scale + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, seed: int = 11) -> Ranker:
    """x: rows of features; label: 1 is preferred to 0. Without both labels every text gets the same score, CUT."""
    z = expand(x)
    mean, sd = (z.mean(axis=0), z.std(axis=0)) if len(z) else (np.zeros(2 * FEATURES), np.ones(2 * FEATURES))
    sd = np.where(sd < 1e-9, 1, sd)
    z = np.clip((z - mean) / sd, -8, 8)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(z.shape[1] if len(z) else 2 * FEATURES)
    if not len(good) or not len(bad):
        return Ranker(mean, sd, weights, 0.0, 1.0)
    r = np.random.default_rng(seed)
    n = PAIRS * max(len(good), len(bad))
    gap = z[r.choice(good, n)] - z[r.choice(bad, n)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(gap @ weights, -30, 30)))
        slope = gap.T @ (1 - p) / n - PENALTY * weights
        bend = np.einsum("ni,nj->ij", gap * (p * (1 - p))[:, None], gap, optimize=False) / n + PENALTY * np.eye(len(weights))
        step = _solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ weights
    levels = np.quantile(s, np.linspace(0.005, 0.995, 199))
    # The quantile under which most training labels come out right, the classes weighing the same.
    right = [(s[good] >= t).mean() + (s[bad] < t).mean() for t in levels]
    threshold = float(np.median(levels[np.flatnonzero(np.array(right) >= max(right) - 1e-12)]))
    return Ranker(mean, sd, weights, threshold, 1.0)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gauss elimination; starts no threads beside the JVM's."""
    m = np.column_stack([a, b]).astype(float)
    for k in range(len(b)):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        rest = np.arange(len(b)) != k
        m[rest] -= np.outer(m[rest, k], m[k])
    return m[:, -1]


def held_out(column: str = "doc_id"):
    return F.expr(f"coalesce(crc32(encode(cast({column} as string), 'UTF-8')) % 4 = 2, false)")


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), batch.column("s"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "s", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from the rows of docs that labels marks, held-out folds left out; at most SAMPLE doc_ids, those of smallest hash, with one text each."""
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("hi"))
    marked = marked.where("quality = hi").where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).select("doc_id", "quality")
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "quality", F.xxhash64("text").alias("s"), "text")
    rows = rows.mapInArrow(_labelled, "doc_id long, quality int, s long, x array<double>")
    # Of texts that share a doc_id one counts, so that no more than SAMPLE rows reach the driver.
    t = rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", "s").alias("x")).toArrow()
    x = np.array(t.column("x").to_pylist(), float).reshape(-1, FEATURES)
    y = t.column("quality").to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the same pairs however rows are dealt
    return fit(x[order], y[order])


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    ranker = model.value
    for batch in batches:
        s = ranker.score(features(batch.column("text")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], [*batch.schema.names, "score"])


def score_quality(docs: DataFrame, ranker: Ranker, keep: list[str]) -> DataFrame:
    """The columns keep of docs (text among them), with score between 0 and 1.

    A null text counts as empty and gets an empty text's score. Rows are scored each for itself; an empty table
    gives an empty result.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", `score` double"
    return rows.mapInArrow(partial(_score, model=model), schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id", "text"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
