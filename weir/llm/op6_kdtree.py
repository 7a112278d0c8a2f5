"""Exact top-k search: a KD-tree for each shard, searched best first under box bounds and a kth score carried on.

Rows are dealt to shards of bounded size by a hash of all they hold; a shard's tree (median splits on the widest side,
leaves with tight boxes) is built once and written as one row of a table. Queries go out in waves of bounded size,
each broadcast to one pass over that table: neither rows nor queries are shuffled. A task takes its shards one after the
other; a query visits the boxes of a shard by falling bound of its product with the box and stops below its kth best
score so far, which it brings from the shards before. A task sends on k rows a query at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.session import bound_batches, settle, table

#: Components of a shard (rows times their length), queries of a wave, rows of a leaf.
SHARD, WAVE, LEAF = 512_000, 20_000, 128
#: Types that a shard's components are stored in: the first that holds them; whole numbers beyond are exact as doubles.
_KINDS = ("int16", "int32", "int64", "float64")
_TREE = "dims int, kind string, ids binary, x binary, low binary, high binary, links binary"


def _numbers(x: np.ndarray, most: float) -> np.ndarray:
    """Whole numbers, given as doubles, for exact products with numbers of at most most: as 64-bit ones if no sum can overflow, else as Python's."""
    if most * max(np.abs(x).max(initial=0), 1) * x.shape[-1] < 2.0**62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _rough(score: int) -> float:
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else -float("inf")


class Tree:
    """Vectors of whole numbers under boxes; a node is (left, right, first, last), its children -1 in a leaf."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.arange(len(x))
        links: list[tuple[int, int, int, int]] = []
        boxes: list[tuple[np.ndarray, np.ndarray]] = []

        def split(a: int, b: int) -> int:
            rows = x[order[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            me = len(links)
            links.append((-1, -1, a, b))
            boxes.append((low, high))
            if b - a > LEAF and (high > low).any():
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows[:, int(np.argmax(high - low))], mid)]
                links[me] = (split(a, a + mid), split(a + mid, b), a, b)
            return me

        split(0, len(x))
        self.ids, self.x, self.links = ids[order], x[order], np.array(links, np.int32)
        self.low, self.high = (np.array([b[k] for b in boxes]) for k in (0, 1))

    def stored(self) -> list:
        most = np.abs(self.x).max(initial=0)
        kind = next(k for k in _KINDS if k == "float64" or most <= np.iinfo(k).max and (k != "int64" or most < 2.0**62))
        return [self.x.shape[1], kind, self.ids.tobytes(), *(a.astype(kind).tobytes() for a in (self.x, self.low, self.high)), self.links.tobytes()]

    @classmethod
    def load(cls, dims: int, kind: str, ids: bytes, x: bytes, low: bytes, high: bytes, links: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, tree.links = np.frombuffer(ids, np.int64), np.frombuffer(links, np.int32).reshape(-1, 4).tolist()
        tree.x, tree.low, tree.high = (np.frombuffer(b, kind).reshape(-1, dims).astype(np.float64) for b in (x, low, high))
        return tree

    def exact(self, most: float) -> Tree:
        """Ready for queries whose components are at most most."""
        self.x, self.low, self.high = (_numbers(a, most) for a in (self.x, self.low, self.high))
        return self

    def top(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> None:
        """Put (score, -id) of rows not named own into best, the heap of the k best so far; ties go to smaller ids."""
        bound = np.maximum(self.low * q, self.high * q).sum(axis=1)
        heap = [(-bound[0], 0)]
        while heap:
            up, at = heapq.heappop(heap)
            if len(best) == k and -up < best[0][0]:
                break
            left, right, a, b = self.links[at]
            if left >= 0:
                for child in (left, right):
                    if len(best) < k or bound[child] >= best[0][0]:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            score = self.x[a:b] @ q
            for i in np.flatnonzero(score >= best[0][0]) if len(best) == k else range(b - a):
                if (row := int(self.ids[a + i])) == own:
                    continue
                item = (int(score[i]), -row)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


def _matrices(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length."""
    ids, dims = t.column("vec_id").to_numpy(), t.column("dims").to_numpy()
    out = {}
    for n in np.unique(dims).tolist():
        mask = dims == n
        v = t.column("v").filter(pa.array(mask)).combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        out[n] = ids[mask], np.asarray(v.flatten(), np.float64).reshape(-1, n)
    return out


def _grow(t: pa.Table) -> pa.Table:
    rows = [Tree(ids, x).stored() for ids, x in _matrices(t).values()]
    kinds = (pa.int32(), pa.string(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in _TREE.split(", ")])


def _search(batches: Iterator[pa.RecordBatch], wave, k: int) -> Iterator[pa.RecordBatch]:
    queries = wave.value
    best = {n: [[] for _ in ids] for n, (ids, _) in queries.items()}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] not in queries:
                continue
            ids, x = queries[row[0]]
            tree = Tree.load(*row)
            most = np.abs(tree.x).max(initial=0)
            x = _numbers(x, most)
            tree.exact(float(np.abs(x).max(initial=0)))
            for own, q, held in zip(ids.tolist(), x, best[row[0]]):
                tree.top(q, own, k, held)
    for n, (ids, _) in queries.items():
        for lo in range(0, len(ids), 2000):
            out = [(own, -i, min(max(s, -(2**63)), 2**63 - 1), s) for own, held in zip(ids[lo : lo + 2000].tolist(), best[n][lo : lo + 2000]) for s, i in held]
            if out:
                own, row, score, exact = zip(*out)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (own, row, score)), pa.array(map(_rough, exact), pa.float64())], ["query_id", "vec_id", "score", "exact"])


def top_k(vectors: DataFrame, step: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by step its k best other rows.

    Components become floor(256 * x); the score is the integer product, ties go to the smaller vec_id. Rows with a
    null vec_id, a null or empty vector or a component that is null, NaN or not finite (256 times it included) take no
    part; vectors meet those of their own length only. Rows that share a vec_id are one another's own row; a repeated
    row is listed once a query. Fewer than k other rows: all of them. Products are exact however large; one that a
    long can't hold is given as the nearest long (such products are told apart as doubles). An empty table gives an
    empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(256D * x) < double('infinity'))"
    whole = F.expr("transform(embedding, x -> case when abs(x) < 1e15 then double(floor(256D * x)) else 256D * x end)").alias("v")
    rows = vectors.where("vec_id is not null").where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole).distinct()
    rows = settle(rows.withColumn("dims", F.size("v")), "vectors")
    sizes = rows.groupBy("dims").agg(F.ceil(F.count("*") * F.col("dims") / SHARD).alias("shards"))
    dealt = rows.join(sizes, "dims").withColumn("shard", F.expr("pmod(xxhash64(vec_id, v), shards)")).select("dims", "shard", "vec_id", "v")
    trees = settle(dealt.groupBy("dims", "shard").applyInArrow(_grow, _TREE), "trees")
    # As many tasks as other stages have, however small the trees' files are.
    trees = trees.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("ids"))
    asked = rows.where(f"vec_id % {step} = 0")
    waves = max(1, -(-asked.count() // WAVE))
    found = None
    for n in range(waves):
        wave = spark.sparkContext.broadcast(_matrices(asked.where(f"pmod(xxhash64(vec_id, v), {waves}) = {n}").toArrow()))
        part = trees.mapInArrow(partial(_search, wave=wave, k=k), "query_id long, vec_id long, score long, exact double").distinct()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        part = settle(part, "found") if waves > 1 else part
        found = part if found is None else found.union(part)
    return found


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
