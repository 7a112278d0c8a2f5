"""Packing: cutting-stock column generation over the histogram of piece lengths.

Texts are tokenised once and cut at multiples of the capacity; only a row of numbers for each piece goes on. Full
pieces are sequences of their own. The lengths of the others, rounded up to classes of GRAIN tokens, form a
histogram of fixed size. On the driver a linear program over patterns (how many pieces of each class share a
sequence) is solved by column generation: a knapsack dynamic program prices patterns against the duals. Patterns
are used as often as their rounded-down amounts say, what is left is packed first-fit. Pieces are ranked in their
class without a global sort (counts by class and bucket give each bucket its first rank), and a rank says which
use of which pattern the piece gets.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.session import bound_batches, settle, table

GRAIN = 8
#: Pieces of a class that are ranked in one task, about.
BUCKET = 20_000
END_ID = 1


@functools.lru_cache(2)
def _encoder(name: str):
    """text -> ids, the same as Tokenizer.from_file(path(name)).encode(text, add_special_tokens=False).ids."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    whole = functools.lru_cache(1)(lambda: Tokenizer.from_file(P.path(name) if "/" not in name else name))
    if name != "byte_bpe_50k.json":
        return lambda text: np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        # The same vocabulary and rules, but for the string of the special token, which only the tokenizer's file knows.
        if "<|endoftext|>" in text:
            return np.array(whole().encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(fast.encode_ordinary(text), np.uint32)

    return encode


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


def _pieces(batches: Iterator[pa.RecordBatch], name: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = _encoder(name)
    turn = 0  # tells repeated rows apart
    for batch in batches:
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
            for a in range(0, len(ids), capacity):
                part = ids[a : a + capacity]
                rows.append((doc, a, len(part), zlib.crc32(part.tobytes()), len(ids), turn))
                turn += 1
        cols = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], [x.split()[0] for x in _PIECES.split(", ")])


def _price(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: an unbounded knapsack by dynamic programming over room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    use = np.flatnonzero(value > 1e-12)
    for r in range(1, room + 1):
        fit = use[sizes[use] <= r]
        if len(fit):
            got = best[r - sizes[fit]] + value[fit]
            k = int(np.argmax(got))
            if got[k] > best[r - 1]:
                best[r], last[r] = got[k], fit[k]
                continue
        best[r] = best[r - 1]
    pattern, r = np.zeros(len(sizes)), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            pattern[last[r]] += 1
            r -= int(sizes[last[r]])
    return float(best[room]), pattern


def _refine(inverse: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A Newton step; einsum, as it starts no threads beside the JVM's."""
    return 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", basis, inverse))


def plan_patterns(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """[(pieces of each class in a sequence, number of such sequences)] that use up demand ({class size: pieces}) exactly."""
    left = {s: n for s, n in sorted(demand.items()) if n > 0}
    out: list[tuple[dict[int, int], int]] = []
    if not left:
        return out
    sizes = np.array(sorted(left))
    d = np.array([left[s] for s in sizes], float)
    m = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    cost = np.ones(m)
    inverse, best, since = np.diag(1 / np.diag(basis)), np.inf, 0
    for turn in range(8 * m):
        if turn % 64 == 63:
            inverse = _refine(inverse, basis)  # the updates below lose digits
        x, y = inverse @ d, cost @ inverse
        best, since = (total, 0) if (total := float(cost @ x)) < best * (1 - 1e-4) else (best, since + 1)
        low = int(np.argmin(y))
        if y[low] < -1e-9:
            enter, c = -np.eye(m)[low], 0.0  # a surplus column
        else:
            value, enter = _price(y, sizes, room)
            c = 1.0
            if value <= 1 + 1e-3 or since > 100:
                break  # any basis gives whole sequences; this one is within a thousandth, or moves no more
        step = inverse @ enter
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        leave = rows[np.argmin(x[rows] / step[rows])]
        basis[:, leave], cost[leave] = enter, c
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
    x = _refine(inverse, basis) @ d
    for j in np.argsort(-x, kind="stable"):
        if cost[j] == 0:
            continue
        pattern = {int(sizes[i]): int(round(basis[i, j])) for i in range(m) if basis[i, j] > 0.5}
        n = min([int(x[j] + 1e-6), *(left[s] // k for s, k in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            for s, k in pattern.items():
                left[s] -= n * k
    while any(left.values()):  # at most a few sequences for each class
        free, pattern = room, {}
        for s in sorted(left, reverse=True):
            k = min(left[s], free // s)
            if k:
                pattern[s] = k
                free -= k * s
        n = min(left[s] // k for s, k in pattern.items())
        out.append((pattern, n))
        for s, k in pattern.items():
            left[s] -= n * k
    return out


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are those of its text and END_ID; a null text is empty and gives END_ID alone. Pieces start at
    multiples of capacity. Repeated rows are packed as often as they occur, a null doc_id is kept; an empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = settle(docs.mapInArrow(partial(_pieces, name=tokenizer, capacity=capacity), _PIECES), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    rows = pieces.count()
    buckets = max(1, -(-rows // BUCKET))
    pieces = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32, salt), {buckets})"))
    counts = pieces.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("class", "bucket", (F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    demand = {r["class"]: r["n"] for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    runs, used, begin = [], 0, dict.fromkeys(demand, 0)
    for pattern, n in plan_patterns(demand, capacity // GRAIN):
        slot = 0
        for s, k in sorted(pattern.items(), reverse=True):
            runs.append((s, begin[s], begin[s] + n * k, k, used, slot))
            begin[s] += n * k
            slot += k
        used += n
    # At most a few hundred classes by a few hundred patterns.
    schema = "class int, lo long, hi long, k long, base long, slot long"
    plan = F.broadcast(spark.createDataFrame(runs or [(0, 0, 0, 1, 0, 0)], schema))
    ranked = pieces.join(first, ["class", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt")) - 1)
    placed = ranked.join(plan, (ranked["class"] == plan["class"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])).drop(plan["class"])
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - lo) div k")).withColumn("slot", F.expr("slot + (rank - lo) % k"))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("offset", F.sum("length").over(before) - F.col("length")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
