"""Centroid clustering of whole-number vectors: exact k-means, distances as matrix products.

Vectors are packed into blocks of a few thousand, written once. A round is one RDD treeAggregate over the blocks: a
task multiplies each block with the centroids, |x|^2 - 2 x.c + |c|^2, and adds up the vectors of each cluster; what it
sends on is bounded by the centroids, and sums merge in a tree. Products run in float64 BLAS where all magnitudes stay
below 2^53, so that every step is exact; beyond that bound in 64-bit integers, and beyond these in Python's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.session import bound_batches, settle, table

#: Clusters, rounds, components of a vector; vectors of a block.
K, ROUNDS, DIMS, BLOCK = 40, 5, 64, 4096
#: Bounds below which whole numbers are exact in float64, and sums safe in 64 bits.
EXACT, SAFE = 2**53, 2**62
_KINDS = ("int8", "int16", "int32", "float64")
_BLOCKS = "ids binary, has binary, kind string, x binary"


def _whole(x: np.ndarray, kind: type) -> np.ndarray:
    """Whole numbers given as doubles or integers, as kind; as Python's integers where kind is object."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape) if kind is object else x.astype(kind)


def kind_for(bound: int) -> type:
    """What numbers up to bound are exact in."""
    return np.float64 if bound < EXACT else np.int64 if bound < SAFE else object


def _most(x: np.ndarray) -> int:
    return int(max(abs(x.max()), abs(x.min()))) if x.size else 0


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids; the type of the result is the one that held them."""
    kind = kind_for(x.shape[1] * (_most(x) + _most(centroids)) ** 2)
    a, c = _whole(x, kind), _whole(centroids, kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the smaller one of ties, and the distance to it."""
    d = distances(x, centroids)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The exact sums of each cluster's vectors, as Python's integers: a product with the 0-1 matrix of who belongs where."""
    kind = kind_for(len(x) * _most(x))
    member = np.zeros((k, len(x)), kind if kind is not object else np.int64)
    member[at, np.arange(len(x))] = 1
    return _whole(member.astype(kind) @ _whole(x, kind), object)


def _unpack(row) -> np.ndarray:
    return np.frombuffer(row.x, row.kind).reshape(-1, DIMS)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            ids = part.column("vec_id")
            v = np.asarray(part.column("v").flatten(), np.float64).reshape(-1, DIMS)
            x = np.floor(256.0 * v) + 0.0
            most = np.abs(x).max(initial=0)
            kind = next(k for k in _KINDS if k == "float64" or most <= np.iinfo(k).max)
            row = (np.asarray(ids.fill_null(0), np.int64).tobytes(), np.asarray(ids.is_valid(), bool).tobytes(), kind, x.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.binary()), pa.array([kind]), pa.array([row[3]], pa.binary())], [c.split()[0] for c in _BLOCKS.split(", ")])


def _add(held: tuple, row, centroids, with_sums: bool) -> tuple:
    """(sums, counts, inertia) with a block's added."""
    x, c = _unpack(row), centroids.value
    at, d = nearest(x, c)
    counts = held[1] + np.bincount(at, minlength=len(c))
    if with_sums:
        return held[0] + _sums(x, at, len(c)), counts, held[2]
    inertia = held[2].copy()
    for k in np.unique(at).tolist():
        mine = d[at == k]
        whole = kind_for(len(mine) * int(mine.max())) is not object
        inertia[k] += int(_whole(mine, np.int64).sum()) if whole else sum(int(v) for v in mine)
    return held[0], counts, inertia


def _merge(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _long(x) -> list[int]:
    return [min(int(v), 2**63 - 1) for v in x]


def _assign(batches: Iterator[pa.RecordBatch], centroids, facts: list[tuple]) -> Iterator[pa.RecordBatch]:
    inertia, total, digests = facts
    for batch in batches:
        for row in batch.to_pylist():
            row = type("Block", (), row)
            ids, has = np.frombuffer(row.ids, np.int64), np.frombuffer(row.has, bool)
            at, d = nearest(_unpack(row), centroids.value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, mask=~has), pa.array(at.astype(np.int32)), pa.array(_long(d), pa.int64()), pa.array(inertia).take(pa.array(at)),
                    pa.array(np.full(len(ids), total)), pa.array(digests).take(pa.array(at)),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Each vector with its cluster, and the centroids: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) and k rows of whole numbers.

    Takes part what has exactly DIMS components, none null, NaN or infinite (256 times it included); components become
    floor(256 * x). The first centroids are the k vectors with the smallest sha256 of `seed:vec_id`, all if there are
    fewer (ties by vector; a missing vec_id has no digest and comes last). Ties of distance go to the smaller number; a
    round sets a centroid to the floor of its vectors' mean, an empty one stays. Repeated rows count each. Numbers are
    exact however large; distances and inertias that a long can't hold are given as the largest long. No vectors, no
    rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = f"embedding is not null and size(embedding) = {DIMS} and forall(embedding, x -> x is not null and not isnan(x) and abs(256D * x) < double('infinity'))"
    rows = vectors.where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    blocks = settle(rows.mapInArrow(_pack, _BLOCKS), "blocks")
    kind = lambda x: _whole(x, kind_for(_most(x)))
    centroids = kind(np.floor(256.0 * np.array([r.v for r in first], np.float64).reshape(-1, DIMS)))
    data = blocks.rdd
    n = len(first)
    zero = (np.zeros((n, DIMS), object), np.zeros(n, np.int64), np.zeros(n, object))
    for last in [False] * rounds + [True]:
        sent = spark.sparkContext.broadcast(centroids)
        sums, counts, inertia = data.treeAggregate(zero, partial(_add, centroids=sent, with_sums=not last), _merge) if n else zero
        if not last:
            moved = _whole(centroids, object)
            for c in np.flatnonzero(counts).tolist():
                moved[c] = sums[c] // int(counts[c])
            centroids = kind(moved)
    facts = (_long(inertia), _long([sum(inertia)])[0], [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids])
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return blocks.mapInArrow(partial(_assign, centroids=spark.sparkContext.broadcast(centroids), facts=facts), out), centroids


def op13_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _round(n: int) -> str:
    """SQL of assignment n, to the centroids c{n}, and of the centroids that follow from it."""
    return f"""
a{n} AS MATERIALIZED (SELECT r, v, CAST(arg_min(c, d * 64 + c) AS BIGINT) AS c, CAST(min(d) AS BIGINT) AS d FROM
    (SELECT r, v, c, list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM x, c{n}) GROUP BY ALL),
s{n} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT c, v, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY ALL),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(m{n}.w, c{n}.w) AS w FROM c{n} LEFT JOIN m{n} USING (c))"""


SQL = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v AS w FROM x ORDER BY c LIMIT 40),{",".join(_round(n) for n in range(6))}
SELECT vec_id, CAST(a5.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a5.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a5 JOIN x USING (r) JOIN c5 ON a5.c = c5.c
"""
