import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weir.llm.op8_packing import op8_packing, pack_documents, plan_patterns


def whole(rows, texts, most_padding):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for d, parts in by.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : at], "<u4").tobytes())
        assert at == len(ids[d])
    for parts in seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(seq) * 2048 - total <= most_padding * total + 2048


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    whole(op8_packing(spark, d).collect(), texts, 0.02)


def test_cases(spark):
    texts = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (4, "été 𝄞 " * 3000), (5, "x" * 40000), (6, " \n\t ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("rank", F.lit(1))
    whole(pack_documents(df).collect(), texts, 1)
    twice = pack_documents(df.limit(1).union(df.limit(1)))
    assert twice.count() == 2 and twice.select("sequence_id", "offset").distinct().count() == 2
    assert pack_documents(df.limit(0)).count() == 0


def test_patterns_use_up_demand():
    demand = {i: int(300 * np.exp(-i / 80) + 20) for i in range(1, 257, 2)}
    got = {}
    plan = plan_patterns(demand, 256)
    for p, n in plan:
        assert sum(s * k for s, k in p.items()) <= 256
        for s, k in p.items():
            got[s] = got.get(s, 0) + n * k
    assert got == demand
    assert sum(n for _, n in plan) * 256 <= 1.01 * sum(s * n for s, n in demand.items())
    assert plan_patterns({}, 256) == [] and plan_patterns({256: 3}, 256) == [({256: 1}, 3)]
