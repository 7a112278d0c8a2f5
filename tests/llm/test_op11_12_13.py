import base64
import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import op11_warc as warc
from weir.llm import op12_filters as filters
from weir.llm import op13_centroids as centroids


def _b32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("x")).withColumn("same", F.lit(1)).withColumn("d", F.lit(2))


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FREQUENT", 4)  # groups of over a quarter of all pages join by broadcast
    hot = "<p>hot\r\n\r\nWARC/1.1\r\né"
    rows = [(i, f"http://h/{i} é", hot if i % 2 else f"<p>{i % 7}" + "x" * (i % 3)) for i in range(3, 203)]
    rows += [(1000, None, None), (1001, "", ""), (None, "u", hot), (None, "u", "only here"), (None, "u", "only here"), (7, "http://h/again", hot), (3, "http://h/3", hot), (2000, "u", "y" * 3_000_000), (2001, "u" * 5000, "y" * 3_000_000)]
    folder, manifest = warc.write_archives(_pages(spark, rows), limit=2000)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(first.get(h or "", 2**63), 2**63 - 1 if i is None else i)
    want = []
    for i, _, h in rows:
        b, o = (h or "").encode(), first[h or ""]
        want.append((i, len(b), _b32(b), "revisit" if o != (2**63 - 1 if i is None else i) else "response", o if o != (2**63 - 1 if i is None else i) else None))
    got = warc.read_archives(folder, manifest, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    texts = {(i, h or "") for i, _, h in rows}
    assert all((r.page_id, bytes(r.payload).decode()) in texts for r in got if r.record_type == "response") and all(r.payload is None for r in got if r.record_type == "revisit")
    files = manifest.collect()
    assert len(files) > 4 and sum(f.records for f in files) == len(rows)  # archives end at the limit
    plain = b"".join(record for _, record in warc.members(open(f"{folder.removeprefix('file://')}/{files[0].file}", "rb")))
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_archives_least_size_and_empty_table(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = warc.read_archives(*warc.write_archives(_pages(spark, rows), least=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]
    assert warc.read_archives(*warc.write_archives(_pages(spark, rows).limit(0))).count() == 0


def test_damaged_records_are_errors():
    record = warc.page_record(5, "http://a/b", b"<p>one", b"s" * 32, None, None, "2026-01-01T00:00:00Z")
    fields, block = warc.parse(record)
    assert warc._page(fields, block)[0][:5] == (5, "http://a/b", 6, _b32(b"<p>one"), "response")
    with pytest.raises(ValueError):
        warc._page(fields, block.replace(b"one", b"two"))
    with pytest.raises(ValueError):
        warc.parse(record[:-1])
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")
    import io

    whole = warc._gzip(record) + warc._gzip(record[:40])
    assert [len(x) for _, x in warc.members(io.BytesIO(whole))] == [len(record), 40]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(whole[:-3])))
    with pytest.raises(zlib.error):
        list(warc.members(io.BytesIO(b"not gzip")))


def _audit(rows, labels):
    """Brute force: every order applied to every part."""
    first, out, failing = {}, [], []
    for i, t, _ in rows:
        key = float("inf") if i is None else i
        first[t or ""] = min(first.get(t or "", key), key)
    for i, t, s in rows:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), (float("inf") if i is None else i) > first[t])
        failing.append((s or "", dict(zip("ABCDE", fails)), *labels.get(i, (False, False))))
    for part in {f[0] for f in failing}:
        mine, shapley = [f[1:] for f in failing if f[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                gone = [f for f in left if f[0][x]]
                left = [f for f in left if not f[0][x]]
                fail = sum(f[0][x] for f in mine)
                steps.append(["".join(order), k + 1, len(left), len(gone), fail - len(gone), sum(f[0][x] and sum(f[0].values()) == 1 for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)])
                shapley[x] += len(gone)
        out += [(part, *s, shapley[s[0][s[1] - 1]]) for s in steps]
    return sorted(out)


def test_filter_audit_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \t\n", "A" * 50, "a $ b", " ".join(words), "\x0b".join(words[:200]) + " ", " ".join(words[:120] * 2), " ".join(words[:99] * 3 + ["|"]), " ".join(words[:300] + ["ABCDEFGHIJKLMNOPQRSTUVWXYZ"] * 3), "é" * 3, " ".join(words * 500)]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, ""])) for i in range(150)]
    rows += [rows[5], rows[5], (7, "other text of a repeated id", "a"), (None, texts[5], "c"), (None, texts[5], "c"), (None, "nowhere else", "c"), (-4, texts[5], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("words", F.lit(1)).withColumn("n", F.lit(1)).withColumn("part", F.lit(0))
    known = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    labels = {i: (any(q == 1 for j, q, _ in known if j == i), any(t == 1 for j, _, t in known if j == i)) for i in range(150)}
    frame = spark.createDataFrame(known, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    got = filters.filter_audit(docs, frame)
    assert sorted(tuple(x) for x in got.collect()) == _audit(rows, labels)
    assert got.columns[:3] == ["part", "filter_order", "step"] and dict(got.dtypes)["step"] == "int"
    assert filters.filter_audit(docs.limit(0), frame).count() == 0
    assert sorted(tuple(x) for x in filters.filter_audit(docs, frame.limit(0)).collect()) == _audit(rows, {})
    assert spark.conf.get("spark.sql.codegen.aggregate.map.twolevel.enabled") == "true"


def _cluster(rows, k, rounds):
    """Brute force in Python's integers."""
    kept = [(i, [int(np.floor(256.0 * x)) for x in v], v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(256.0 * x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [list(v) for _, v, _ in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c)) for _, v, _ in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(c)):
            if mine := [r[1] for r, (_, m) in zip(kept, at) if m == n]:
                c[n] = [sum(x) // len(mine) for x in zip(*mine)]
    at, cap = assign(), 2**63 - 1
    own = [sum(d for d, m in at if m == n) for n in range(len(c))]
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, min(d, cap), min(own[n], cap), min(sum(own), cap), digest[n]) for (i, _, _), (d, n) in zip(kept, at)), key=str)


@pytest.mark.parametrize("scale", [0.3, 1e5, 1e8, 1e40])  # float64, its bound, 64-bit integers and Python's
def test_clusters_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(centroids, "BLOCK", 16)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(0, scale, 64)]) for i in range(-5, 70)]
    rows += [rows[3]] * 30 + [(None, rows[1][1]), (100, [0.0] * 64), (101, [-0.0] * 64), (3, [1.0] * 64)]
    bad = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [float("nan")] + [0.0] * 63), (206, [float("inf")] * 64), (207, [1e308] * 64)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("x", F.lit(2)).repartition(3)
    got, _ = centroids.cluster(df, k=7)
    assert sorted((tuple(x) for x in got.collect()), key=str) == _cluster(rows, 7, 5)


def test_clusters_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [1.5] * 64)], "vec_id int, embedding array<float>")
    got, c = centroids.cluster(df)
    assert len(c) == 3 and sorted((r.vec_id, r.distance, r.inertia) for r in got.collect()) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert centroids.cluster(df.limit(0))[0].count() == 0 and centroids.cluster(df.where("vec_id = 2"), k=1)[1].tolist() == [[384.0] * 64]


def test_distances_choose_what_holds_them():
    for most, kind in ((1000, np.float64), (2**26, np.int64), (2**29, object), (2**80, object)):
        x = np.array([[most, -most, 0, 1]], object)
        d = centroids.distances(x.astype(float) if most < 2**60 else x, np.array([[0, 0, 0, 0], [-most, most, 0, 0]], object))
        assert d.dtype == kind and [int(v) for v in d[0]] == [2 * most**2 + 1, 8 * most**2 + 1]
