import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_op7 import brute, shingles
from tests.llm.test_op8 import whole
from tests.llm.test_op10 import base as secret_base
from weir.llm import op1_mixing, op5_quality, op10_secrets
from weir.session import settle

D = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    rows = op5_quality.op5_quality(spark, D).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def plain_features(text):
    """The features of one text, character by character."""
    t = text or ""
    b = t.encode()
    kinds = [next((k for k, chars in enumerate(op5_quality._CLASSES) if c < 128 and chr(c) in chars), len(op5_quality._CLASSES) + (c >= 128)) for c in b]
    share = [kinds.count(k) / max(len(b), 1) for k in range(len(op5_quality._CLASSES) + 2)]
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0d]+", b)]
    row = [math.sqrt(x) for x in share] + [math.log1p(len(b))]
    if not words:
        return row + [0.0] * (op5_quality.FEATURES - len(row))
    n, sizes, times = len(words), [e - a for a, e, _ in words], Counter(w for _, _, w in words)
    full = [x for x in b.split(b"\n") if x.strip()]
    mean = sum(sizes) / n
    row += [math.log1p(n), mean / 10, math.sqrt(sum((x - mean) ** 2 for x in sizes) / n) / 10, len(times) / n, max(times.values()) / n]
    row += [sum(kinds[e - 1] == 8 for _, e, _ in words) / n, sum(kinds[e - 1] == 7 for _, e, _ in words) / n, sum(kinds[a] == 1 for a, _, _ in words) / n, len(set(full)) / max(len(full), 1), math.log1p(len(full))]
    row += [sum(x > 20 for x in sizes) / n, sum(x[2] == y[2] for x, y in zip(words, words[1:])) / (n - 1) if n > 1 else 0, len(times) / math.sqrt(n) / 10]
    return row


def test_quality_stage_against_plain_features(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    x = np.array([plain_features(r.text) for r in rows])
    assert np.allclose(x, op5_quality.features(pa.array([r.text for r in rows])), atol=1e-9)
    ranker = op5_quality.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    want = {r.doc_id for r, s in zip(rows, ranker.score(x)) if s >= op5_quality.CUT}
    assert {r.doc_id for r in P.quality(spark, docs, D).collect()} == want and 0 < len(want) < len(rows)


def test_training_takes_one_text_a_doc_id(spark):
    docs = spark.createDataFrame([(i % 6, f"word {i} " * (1 + i % 5)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    a, b = (op5_quality.train(d, labels) for d in (docs, docs.repartition(7)))
    assert np.allclose(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x" * 100000), (None, " \n")], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("quality", F.lit(2))
    none = op5_quality.train(docs, spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    out = op5_quality.score_quality(docs, none, ["doc_id", "text"])
    assert [round(r.score, 9) for r in out.collect()] == [0.7] * 5 and op5_quality.score_quality(docs.limit(0), none, ["text"]).count() == 0
    x = op5_quality.features(pa.array([None, "", "a b"]))
    assert np.isfinite(x).all() and (x[0] == x[1]).all()


def fitted(cells, want, rounds=200):
    w = {k: t for k, t in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            got = {}
            for k, x in w.items():
                got[k[d]] = got.get(k[d], 0) + x
            w = {k: x * want[d][k[d]] / got[k[d]] for k, x in w.items()}
    return w


def test_mixing_against_plain_fitting(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = op1_mixing.fit_cells(op1_mixing._described(docs, ["doc_id"]).drop("row")).collect()
    cells = {(r.source, r.lang, r.topic): r.tokens for r in got}
    total = sum(cells.values())
    want = []
    for d, name in enumerate(op1_mixing.DIMS):
        share = {}
        for k, t in cells.items():
            share[k[d]] = share.get(k[d], 0) + t / total
        power = {v: s ** op1_mixing.POWER[name] for v, s in share.items()}
        want.append({v: s / sum(power.values()) for v, s in power.items()})
    w = fitted(cells, want)
    assert max(abs(w[r.source, r.lang, r.topic] - r.weight) for r in got) < 1e-4
    assert abs(sum(r.p * r.tokens for r in got) - 0.5 * total) < 1e-3 * total
    drawn = op1_mixing.op1_source_mixing(spark, D).collect()
    assert abs(sum(r.tokens for r in drawn) - 0.5 * total) < 0.15 * total
    assert sorted(r.doc_id for r in drawn) == sorted(r.doc_id for r in op1_mixing.op1_source_mixing(spark, D).collect())


def drawn(doc, seed=7):
    """A row's draw between 0 and 1: Spark's hash of its doc_id and the seed."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", doc), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", seed), h) % (1 << 53) / float(1 << 53)


def test_mixture_stage_against_plain_fitting_and_drawing(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = op1_mixing._described(docs, ["doc_id"]).select("row.doc_id", "source", "lang", "topic", "tokens").collect()
    cells = Counter()
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.tokens
    total = sum(cells.values())
    want = []
    for d, name in enumerate(op1_mixing.DIMS):
        share = Counter()
        for k, t in cells.items():
            share[k[d]] += t / total
        power = {v: s ** op1_mixing.POWER[name] for v, s in share.items()}
        want.append({v: s / sum(power.values()) for v, s in power.items()})
    w = fitted(cells, want)
    for d in range(3):  # the fitted weights reach all three marginals
        got = Counter()
        for k, x in w.items():
            got[k[d]] += x
        assert max(abs(got[v] - want[d][v]) for v in want[d]) < 1e-6
    lo, hi = 0.0, 1e12
    for _ in range(200):  # the factor under which expected tokens meet the budget, by halving
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(w[k] / t * mid, 1) * t for k, t in cells.items()) < 0.5 * total else (lo, mid)
    p = {k: min(w[k] / t * hi, 1) for k, t in cells.items()}
    sure = {r.doc_id: drawn(r.doc_id) < p[r.source, r.lang, r.topic] for r in rows if abs(drawn(r.doc_id) - p[r.source, r.lang, r.topic]) > 1e-3}
    got = {r.doc_id for r in P.mixture(spark, docs, D).collect()}
    assert len(sure) > 0.98 * len(rows) and {k for k, v in sure.items() if v} == got & set(sure)


def test_topics(spark):
    texts = {"It is LICENSED so": "license", "CopyRight me": "license", "mail a.b@c-d.org": "contact", "@c.org": "prose", "a | b": "table", "in 1999 it": "numbers", "abc": "prose", " ": "empty"}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    assert {r.text: r.t for r in df.select("text", op1_mixing.topic().alias("t")).collect()} == texts | {None: "empty"}


def test_null_and_written_names_are_apart(spark):
    df = spark.createDataFrame([(i, "x", None if i % 2 else "", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    assert op1_mixing.fit_cells(op1_mixing._described(df, ["doc_id"])).count() == 2


def test_mixing_edges(spark):
    rows = [(i, None if i % 7 == 0 else "text " * i, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}") for i in range(60)] + [(None, "x", "en", "s1")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string").withColumn("p", F.lit("z")).withColumn("weight", F.lit("z"))
    out = op1_mixing.mix(df, df.columns, budget=0.9, targets={"lang": {"en": 3.0, None: 1.0}}).select("row.*")
    assert out.columns == df.columns and 0 < out.count() <= 64
    assert op1_mixing.mix(df.limit(0), ["doc_id"]).count() == 0


def near_kept(rows):
    """Rows (doc_id, text) that stay: of each group of linked texts the first by doc_id and the text's hash."""
    order = lambda r: ((1 << 63) - 1 if r[0] is None else r[0], struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))[0])
    texts = sorted(set(t or "" for _, t in rows))
    group = {t: c for t, (_, _, c) in zip(texts, sorted_by_place(texts))}
    first = {}
    for r in rows:
        if shingles(r[1]):
            c = group[r[1] or ""]
            first[c] = min(first.get(c, (order(r), r)), (order(r), r), key=lambda x: x[0])
    return sorted([r for r in rows if not shingles(r[1])] + [r for _, r in first.values()], key=str)


def sorted_by_place(texts):
    return sorted(brute(list(enumerate(texts))), key=lambda x: x[0])


def test_near_duplicates_stage(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(400)
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    more = [(5, "a copy", "en", "s", 4)] * 3 + [(None, "a b", None, None, 3), (None, "a b", None, None, 3), (99999, None, "en", "s", None), (99999, None, "en", "s", None), (7001, "quite different words", "en", "s", 1), (7001, "and these are others", "en", "s", 1)]
    more += [(8000 + i, near + (" x" if i % 2 else ""), "en", "s", 9) for i in range(6)] + [(None, near, "en", "s", 9)]
    docs = settle(docs.union(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")), "t")
    kept = P.near_duplicates(spark, docs, D)
    assert kept.columns == P.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == near_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert P.near_duplicates(spark, docs.limit(0), D).count() == 0
    packed = P.packing(spark, kept.where("doc_id < 7001 and doc_id <> 5"), D).collect()
    whole(packed, [(r.doc_id, r.text) for r in kept.where("doc_id < 7001 and doc_id <> 5").collect()], 0.05)


def test_secrets_stage_against_plain_scan(spark):
    ratios = op10_secrets.train_markov(op10_secrets.labelled_samples(spark))
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(300).union(spark.createDataFrame([(1, "key Zk3Tq9XvB7LmPw2RdY8sHc4N token=abcdef12 end", "en", "s", 1), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"))
    size = len(op10_secrets.ALPHABET) + 1
    code = {c: i + 1 for i, c in enumerate(op10_secrets.ALPHABET)}

    def clean(text):
        spans = [(a, e) for a, _, e in secret_base(text)]
        for m in re.finditer(op10_secrets.CANDIDATE, text):
            v = m[0]
            if re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not any(a < m.end() and m.start() < e for a, e in spans[: len(secret_base(text))]):
                if sum(ratios[code[x] * size + code[y]] for x, y in zip(v, v[1:])) / (len(v) - 1) >= op10_secrets.MARGIN:
                    spans.append(m.span())
        out, at = "", 0
        merged = []
        for a, e in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([a, e])
        for a, e in merged:
            out, at = out + text[at:a] + "[SECRET]", e
        return out + text[at:]

    got = sorted(((r.doc_id, r.text, r.n_chars) for r in P.secrets(spark, docs, D).collect()), key=str)
    want = [(r.doc_id, r.text and clean(r.text), r.n_chars) for r in docs.collect()]
    want = sorted(((d, t, n if t is None or "[SECRET]" not in t else len(t)) for d, t, n in want), key=str)
    assert got == want and any("[SECRET]" in (t or "") for _, t, _ in got)


def test_stages_with_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x" * 100_000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("z")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
    for name, stage in P.STAGES:
        out = stage(spark, odd, D)
        assert (out.columns == P.COLUMNS) == (name != "packing") and out.count() >= 0
        assert stage(spark, odd.limit(0), D).count() == 0


def test_whole_pipeline(spark):
    out = P.run(spark, D)
    assert out.count() > 100 and out.select("sequence_id", "offset").distinct().count() == out.count()
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
