"""Substring dedup: suffixes grouped by variable-length prefixes, and the deep nodes of each group's subtree.

A suffix's path begins with the hashes of its words. A prefix is FIRST words long at first (BITS bits of each word's
hash); the suffixes below each prefix are counted over all texts, and a prefix with more than GROUP suffixes is extended
by a word, until every group fits in memory; one that is still too large at DEEPEST words is cut by the rest of the
path. Runs of neighbouring prefixes form blocks, each the leaves of one subtree. Only repeats of `width` words or more
matter, so a subtree is cut at that depth: in place of the edges from the prefix down to it, a leaf carries a 64-bit
digest of its first `width` words, and leaves of one digest are those of one deep node. All leaves of such a node but
the earliest are starts of repeats, and runs of such starts are the maximal repeats (see maximal_repeats). A task
resolves the leaves it holds itself and sends on one leaf a node, so a passage that a third of all texts holds costs
one entry a task.

Digests are compared within a block only, whose leaves agree in their prefix. Of N windows in blocks of G, two different
ones are taken for one with odds of about N * G / 2 ** 65: 1e-4 at 30 GB, one window in all at 200 TB.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import bloom
from weir.llm import wordhash as W
from weir.session import bound_batches, settle, table

#: Suffixes that a task holds before it deals them out; suffixes that a block should hold at most.
FLUSH, GROUP = 500_000, 1_000_000
#: Bits of a prefix for each of its words, and least and most words of a prefix.
BITS, FIRST, DEEPEST = 8, 2, 7
#: Heavy prefixes of a length at most.
RUNS = 4096
_SPAN = BITS * DEEPEST
#: Stands for a missing doc_id.
LAST = (1 << 63) - 1


def _windows(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: text index, start, digest and prefix bits of each suffix of width words or more."""
    col = batch.column("text")
    offs = W.text_buffers(col)[1]
    for lo, hi in W.chunks(offs):
        h, _, _, wo = W.words(*W.text_buffers(col.slice(lo, hi - lo)))
        count = np.maximum(np.diff(wo) - width + 1, 0)
        total = int(count.sum())
        if not total:
            continue
        text = np.repeat(np.arange(hi - lo, dtype=np.int32), count)
        start = (np.arange(total) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        at = wo[text] + start
        code = np.zeros(len(h), np.uint64)
        for j in range(DEEPEST):
            code[: len(h) - j] |= (h[j:] >> np.uint64(64 - BITS)) << np.uint64(_SPAN - BITS * (j + 1))
        yield text + lo, start, W.grams(h, width)[at], code[at]


def _count_prefixes(batches: Iterator[pa.RecordBatch], width: int, length: int, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many suffixes each prefix of that length has; of longer ones only those below a heavy prefix."""
    found: dict[int, int] = {}
    for batch in batches:
        for _, _, _, code in _windows(batch, width):
            p = code >> np.uint64(_SPAN - BITS * length)
            if length > FIRST:
                p = p[np.isin(p >> np.uint64(BITS), heavy)]
            for k, c in zip(*(x.tolist() for x in np.unique(p, return_counts=True))):
                found[k] = found.get(k, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["prefix", "n"])


class Blocks:
    """Blocks of suffixes: where each run of prefixes begins, and into how many blocks its digests are cut."""

    def __init__(self, leaves: list[tuple[int, int]], most: int = 0):
        """Runs hold most suffixes or GROUP, whichever is more, unless one prefix has more; a block has GROUP or little more."""
        first, cuts, held = [0], [1], 0
        for code, n in sorted(leaves):
            if held and held + n > max(most, GROUP):
                first.append(code), cuts.append(1)
                held = 0
            held += n
            cuts[-1] = max(cuts[-1], -(-held // GROUP))
        self.first, self.cuts = np.array(first, np.uint64), np.array(cuts, np.uint64)
        self.number = np.cumsum(self.cuts) - self.cuts
        self.total = int(self.cuts.sum())

    def of(self, code: np.ndarray, digest: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.first, code, "right") - 1
        return (self.number[run] + (((digest >> np.uint64(32)) * self.cuts[run]) >> np.uint64(32))).astype(np.int64)


def _blocks(docs: DataFrame, width: int) -> tuple[Blocks, int]:
    """Blocks, and the number of suffixes.

    The driver gets a row for each prefix: 2 ** (FIRST * BITS) of them, and at each further length 2 ** BITS for each
    heavy one. Heavy is what has more than GROUP suffixes, and more than one in RUNS of all: there are RUNS such prefixes
    of a length at most, however large the input is, and the runs of prefixes in between are cut by digests.
    """
    leaves: list[tuple[int, int]] = []
    heavy, total, most = np.zeros(0, np.uint64), 0, 0
    for length in range(FIRST, DEEPEST + 1):
        counted = docs.mapInArrow(partial(_count_prefixes, width=width, length=length, heavy=heavy), "prefix long, n long")
        t = counted.groupBy("prefix").agg(F.sum("n").alias("n")).toArrow()
        p, n = t.column("prefix").to_numpy().astype(np.uint64), t.column("n").to_numpy()
        total = total or int(n.sum())
        most = max(GROUP, -(-total // RUNS))
        big = (n > most) & (length < DEEPEST)
        leaves += zip((p[~big] << np.uint64(_SPAN - BITS * length)).tolist(), n[~big].tolist())
        heavy = p[big]
        if not len(heavy):
            break
    return Blocks(leaves, most), total


def _narrow(a: np.ndarray) -> bytes:
    """Numbers below 2 ** 24, three bytes each."""
    return np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(b, np.uint8).reshape(-1, 3)
    return out.reshape(-1).view(np.uint32)


def _names(batch: pa.RecordBatch, repeated) -> tuple[np.ndarray, np.ndarray]:
    """d and s of rows; of s all 64 bits where another row may have the same d, else 32."""
    d, s = batch.column("d").to_numpy(), batch.column("s").to_numpy()
    return d, np.where(repeated.value.has(d) | (d == LAST), s, s & ((1 << 32) - 1))


def _halves(s: np.ndarray) -> bytes:
    """The low halves of numbers, then, if any is not 0, which high halves are not 0 and those."""
    high = (s >> 32).astype(np.int32)
    low = (s & ((1 << 32) - 1)).astype(np.uint32).tobytes()
    return low + np.packbits(high != 0).tobytes() + high[high != 0].tobytes() if high.any() else low


def _whole(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint32, n).astype(np.int64)
    if len(b) > 4 * n:
        flags = -(-n // 8)
        some = np.unpackbits(np.frombuffer(b, np.uint8, flags, 4 * n), count=n).astype(bool)
        out[some] |= np.frombuffer(b, np.int32, offset=4 * n + flags).astype(np.int64) << 32
    return out


_ENTRIES = "block long, digests binary, at binary, doc_at binary, d binary, s binary, again_d binary, again_s binary, again_at binary"
_AGAIN = "bucket long, texts long, d binary, s binary, at binary"


def _suffixes(batches: Iterator[pa.RecordBatch], width: int, blocks: Blocks, repeated) -> Iterator[pa.RecordBatch]:
    d_all: list[np.ndarray] = []
    s_all: list[np.ndarray] = []
    held: list[tuple[np.ndarray, ...]] = []
    state = {"docs": 0, "n": 0}

    def deal() -> pa.RecordBatch:
        d, s = np.concatenate(d_all), np.concatenate(s_all)
        doc, start, digest, block = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((s, d))
        rank = np.empty(len(d), np.int32)
        d, s = d[order], s[order]
        fresh = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))
        rank[order] = np.cumsum(fresh) - 1  # rows that agree in both are one text
        d, s, doc = d[fresh], s[fresh], rank[doc]
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
        rows = []
        for b, lo, hi in zip(block[order][cut].tolist(), cut, np.append(cut[1:], len(order))):
            x = order[lo:hi]
            x = x[np.argsort(digest[x], kind="stable")]
            same = digest[x][1:] == digest[x][:-1]
            first = np.append(True, ~same)
            if same.any():
                tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
                x[tied] = x[tied][np.lexsort((start[x[tied]], doc[x[tied]], digest[x[tied]]))]
            head = x[first][np.cumsum(first) - 1]
            y, again = x[first], x[(doc[x] != doc[head]) | (start[x] != start[head])]
            own, inverse = np.unique(doc[y], return_inverse=True)
            # The entries of a text are named by their place in the texts at hand, laid end to end.
            reach = np.zeros(len(own), np.int64)
            np.maximum.at(reach, inverse, start[y] + 1)
            base = np.cumsum(reach) - reach
            at = base[inverse] + start[y]
            at = _narrow(at) if len(at) == 0 or at.max() < 1 << 24 else at.astype(np.int64).tobytes()
            rows.append((b, W.pack(digest[y]), at, base.astype(np.uint32).tobytes(), d[own].tobytes(), _halves(s[own]), d[doc[again]].tobytes(), _halves(s[doc[again]]), start[again].astype(np.uint32).tobytes()))
        d_all.clear(), s_all.clear()
        state.update(docs=0, n=0)
        names = [x.split()[0] for x in _ENTRIES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k else pa.int64()) for k, x in enumerate(zip(*rows))], names)

    for batch in batches:
        d, s = _names(batch, repeated)
        lo = 0
        for text, start, digest, code in _windows(batch, width):
            hi = int(text[-1]) + 1
            d_all.append(d[lo:hi]), s_all.append(s[lo:hi])
            held.append((text - np.int32(lo - state["docs"]), start, digest, blocks.of(code, digest).astype(np.uint16 if blocks.total < 65536 else np.int64)))
            state["docs"] += hi - lo
            state["n"] += len(text)
            lo = hi
            if state["n"] >= FLUSH:
                yield deal()
    if held:
        yield deal()


def _bucket(d: np.ndarray, s: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(d ^ (d >> 17) ^ s, buckets)


def _deep_nodes(t: pa.Table, buckets: int) -> pa.Table:
    """The leaves of a block's deep nodes without the earliest of each node, by bucket of texts."""
    digests, ds, ss, starts, ad, as_, aat = [], [], [], [], [], [], []
    for row in zip(*(t.column(c).to_pylist() for c in ("digests", "at", "doc_at", "d", "s", "again_d", "again_s", "again_at"))):
        g, at, d = W.unpack(row[0]), row[1], np.frombuffer(row[3], np.int64)
        base, s = np.frombuffer(row[2], np.uint32).astype(np.int64), _whole(row[4], len(d))
        at = np.frombuffer(at, np.int64) if len(at) == 8 * len(g) else _wide(at).astype(np.int64)
        doc = np.searchsorted(base, at, "right") - 1
        digests.append(g), ds.append(d[doc]), ss.append(s[doc]), starts.append((at - base[doc]).astype(np.int32))
        ad.append(np.frombuffer(row[5], np.int64)), as_.append(_whole(row[6], len(ad[-1]))), aat.append(np.frombuffer(row[7], np.uint32).astype(np.int64))
    g = np.concatenate(digests)
    order = np.argsort(g, kind="stable")
    same = np.diff(g[order]) == 0
    x = order[np.append(same, False) | np.append(False, same)]
    del order, same
    g, d, s, at = (np.concatenate(y)[x] for y in (digests, ds, ss, starts))  # only leaves of deep nodes go on
    digests.clear(), ds.clear(), ss.clear(), starts.clear()
    x = np.lexsort((at, s, d, g))
    if len(x):
        first = np.append(True, g[x][1:] != g[x][:-1])
        head = x[first][np.cumsum(first) - 1]
        again = x[(d[x] != d[head]) | (s[x] != s[head]) | (at[x] != at[head])]
    else:
        again = x
    d, s, at = np.concatenate([d[again], *ad]), np.concatenate([s[again], *as_]), np.concatenate([at[again], *aat])
    bucket = _bucket(d, s, buckets)
    order = np.lexsort((at, s, d, bucket))
    d, s, at, bucket = d[order], s[order], at[order].astype(np.uint32), bucket[order]
    name, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))
    cols = [[x[a:b].tobytes() for a, b in zip(first, ends)] for x in (d, s, at)]
    fresh = np.append(0, np.cumsum(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])) if len(d) else []))
    return pa.table({"bucket": name.astype(np.int64), "texts": (fresh[ends] - fresh[first]).astype(np.int64), **{k: pa.array(v, pa.binary()) for k, v in zip(("d", "s", "at"), cols)}})


def _filter_bits(t: pa.Table, bits: int) -> pa.Table:
    d, s = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in t.column(c).to_pylist())]) for c in ("d", "s"))
    return pa.Table.from_batches([bloom.bits_of(np.unique(d ^ s), bits)])


_OUT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(ids: list, texts: list, starts: list[np.ndarray | None], width: int) -> dict:
    n_words, n_removed, kept = [], [], []
    for text, at in zip(texts, starts):
        w = (text or "").encode().split()
        n_words.append(len(w))
        if at is None or not len(at):
            n_removed.append(0)
        else:
            edge = np.zeros(len(w) + width + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
            stay = np.cumsum(edge)[: len(w)] == 0
            n_removed.append(len(w) - int(stay.sum()))
            w = [w[i] for i in np.flatnonzero(stay).tolist()]
        kept.append(b" ".join(w).decode())
    return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string())}


def _touched(batches: Iterator[pa.RecordBatch], known, repeated) -> Iterator[pa.RecordBatch]:
    """The rows that may lose words, with s as in entries."""
    for batch in batches:
        d, s = _names(batch, repeated)
        batch = batch.set_column(batch.schema.get_field_index("s"), "s", pa.array(s))
        yield batch.filter(pa.array(known.value.has(d ^ s)))


def _untouched(batches: Iterator[pa.RecordBatch], known, repeated, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, s = _names(batch, repeated)
        batch = batch.filter(pa.array(~known.value.has(d ^ s)))
        yield pa.RecordBatch.from_pydict(_kept(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), [None] * batch.num_rows, width))


def _remove(t: pa.Table, width: int) -> pa.Table:
    """Texts of a bucket without their repeats; rows are texts (text given) and starts of repeats (text null)."""
    given = t.column("text").is_valid()
    docs, again = t.filter(given), t.filter(pa.compute.invert(given))
    d, s = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in again.column(c).to_pylist())]) for c in ("ds", "ss"))
    at = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in again.column("at").to_pylist())]).astype(np.int64)
    order = np.lexsort((s, d))
    d, s, at = d[order], s[order], at[order]
    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]))) if len(d) else np.zeros(0, np.int64)
    where = {(int(d[a]), int(s[a])): at[a:b] for a, b in zip(new, np.append(new[1:], len(d)))}
    starts = [where.get(x) for x in zip(docs.column("d").to_pylist(), docs.column("s").to_pylist())]
    return pa.table(_kept(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), starts, width))


def _repeats(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int, object]:
    """docs with names (doc_id, text, d, s), starts of repeats by bucket of texts, the number of buckets, and which d several rows share."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("s"))
    # A prefilter: a doc_id that it takes for a repeated one only gets a longer name.
    shared = settle(docs.where("doc_id is not null").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "shared")
    repeated = spark.sparkContext.broadcast(bloom.of_keys(shared, shared.count()))
    blocks, total = _blocks(docs.select("text"), width)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP))
    entries = docs.select("d", "s", "text").mapInArrow(partial(_suffixes, width=width, blocks=blocks, repeated=repeated), _ENTRIES)
    again = settle(entries.groupBy("block").applyInArrow(lambda t: _deep_nodes(t, buckets), _AGAIN), "again")
    return docs, again, buckets, repeated


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row of docs (doc_id, text), kept being the words that stay, joined by one space.

    A word goes if a window of width words of its text covers it whose word sequence also starts earlier, that
    is in a row of smaller doc_id or further left in the same row; windows are judged on the input. A null or
    wordless text has 0 words and an empty kept. Rows without a doc_id come after all others; rows that share a
    doc_id are ordered by a hash of their texts, and rows that agree in both are one document, all treated
    alike. An empty table gives an empty result; other columns are ignored.

    A text is named by its doc_id and, where rows share one or have none, by 64 bits of its hash; among N different
    texts of one doc_id two share a name with odds of about N * N / 2 ** 65.
    """
    docs, again, buckets, repeated = _repeats(docs, width)
    bits = bloom.size_for(again.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0])
    # By bucket, so that a text counts once however many blocks it is in. One Python step a task: a second one would
    # double the workers that stay for the stages after it.
    parts = again.select("bucket", "d", "s").groupBy("bucket").applyInArrow(lambda t: _filter_bits(t, bits), "w long, bits long")
    known = docs.sparkSession.sparkContext.broadcast(bloom.gather(parts, bits))
    rest = docs.mapInArrow(partial(_untouched, known=known, repeated=repeated, width=width), _OUT)
    some = docs.mapInArrow(partial(_touched, known=known, repeated=repeated), docs.schema)
    some = some.withColumn("bucket", F.expr(f"pmod(d ^ shiftright(d, 17) ^ s, {buckets}L)"))
    starts = again.select("bucket", F.col("d").alias("ds"), F.col("s").alias("ss"), "at")
    both = some.unionByName(starts, allowMissingColumns=True)
    return rest.union(both.groupBy("bucket").applyInArrow(lambda t: _remove(t, width), _OUT))


def _runs(t: pa.Table, width: int) -> pa.Table:
    d, s = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in t.column(c).to_pylist())]) for c in ("d", "s"))
    at = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in t.column("at").to_pylist())]).astype(np.int64)
    order = np.lexsort((at, s, d))
    d, s, at = d[order], s[order], at[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (at[1:] > at[:-1] + 1))) if len(d) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(d)) - 1 if len(first) else first
    return pa.table({"doc_id": pa.array(d[first], mask=d[first] == LAST), "start": at[first], "length": at[last] - at[first] + width})


def maximal_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, start, length), in words, of each longest stretch of a text (one row a text and stretch) all of whose windows of width words also start earlier, as in remove_repeats."""
    _, again, _, _ = _repeats(docs, width)
    return again.groupBy("bucket").applyInArrow(lambda t: _runs(t, width), "doc_id long, start long, length long")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT *, CASE WHEN count(*) OVER f = 20 THEN string_agg(x, ' ') OVER f END AS win FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, x, CASE WHEN win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM g),
c AS (SELECT doc_id, i, x, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
k AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
