import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weir.llm import op3_substrings as op
from weir.llm.op3_substrings import op3_substring_dedup, remove_repeats


def brute(rows, width=20):
    """rows: (doc_id, text) with distinct doc_ids."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][i : i + width]), (d, i))
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone.update(range(i, i + width))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op3_substring_dedup(spark, d).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in brute(rows)]


@pytest.mark.parametrize("group, runs", [(50, 4096), (50, 3), (1_000_000, 4096)])
def test_shared_passages_and_deep_prefixes(spark, monkeypatch, group, runs):
    monkeypatch.setattr(op, "GROUP", group)
    monkeypatch.setattr(op, "RUNS", runs)
    r = random.Random(5)
    vocab = ["the", "the", "the", "a", "b", "c", "dé", "e"]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randrange(90))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = passage[: r.randrange(15, 60)]
        rows.append((i * 7 % 80, "\t".join(w)))
    rows += [(200, "x " * 500), (201, "x " * 19), (202, None), (203, ""), (204, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("d", F.lit("z")).withColumn("kept", F.lit(1))
    got = sorted(tuple(x) for x in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect())
    assert got == brute(rows)


def test_a_hot_deep_prefix_is_cut_by_the_rest_of_the_path(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 40)
    r = random.Random(8)
    rows = [(i, " ".join(["same"] * 8 + [r.choice("abcdef") for _ in range(r.randrange(10, 16))])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert op._blocks(df.select("text"), 20)[0].cuts.max() > 3
    assert sorted(tuple(x) for x in remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()) == brute(rows)


def test_maximal_repeats(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[10:45], "y", *words[50:75]])), (3, " ".join(words[:19]))]
    got = sorted(tuple(x) for x in op.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(2, 1, 35), (2, 37, 25)]


def test_edges(spark):
    t = " ".join(f"w{i}" for i in range(30))
    u = " ".join(f"w{i}" for i in range(5, 40))
    rows = [(None, t), (3, t), (3, t), (4, u), (9, t + " tail")]
    got = sorted((r[0] or -1, r[1], r[2]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 30, 30), (3, 30, 0), (3, 30, 0), (4, 35, 25), (9, 31, 30)]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7, (1 << 63) - 1])
def test_texts_of_one_doc_id_whose_hashes_agree_in_32_bits(spark, doc_id):
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(doc_id, f"x{i} {passage}") for i in (83182, 182600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert df.select(F.xxhash64("text").bitwiseAND((1 << 32) - 1)).distinct().count() == 1
    assert sorted((r[1], r[2]) for r in remove_repeats(df).collect()) == [(26, 0), (26, 25)]


def test_heavy_prefixes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 20)
    monkeypatch.setattr(op, "RUNS", 8)
    r = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(r.choice("abc") for _ in range(100))) for i in range(60)], "doc_id long, text string")
    blocks, total = op._blocks(df, 20)
    assert total == 60 * 81 and len(blocks.first) <= 2 * 8 + 1  # without the bound some hundred runs of 20 suffixes
    assert blocks.total >= total // 20  # and yet blocks are as small
