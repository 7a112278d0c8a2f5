import duckdb
from pyspark.sql import functions as F

from weir.llm.op9_licenses import _CC, _GNU, BASE, SQL, op9_license_scan, scan_licenses, template_words

COLS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_whole_table_against_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(c.execute(f"SELECT {', '.join(COLS)} FROM ({SQL})").fetchall())
    got = sorted(tuple(r) for r in op9_license_scan(spark, d).select(*COLS).collect())
    assert got == want and sum(r[2] for r in got) > 10


def test_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "!?"), (4, "Under the MIT-License! under the mit license under the mit license."),
        (5, "x CC BY NC cc-by-nc é"), (6, "This program is free software: you CAN redistribute it and/or modify it, under the terms of the new GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
        (7, "the terms of the work"), (4, "Under the MIT-License! under the mit license under the mit license."), (None, "Apache License, Version 2.0"), (8, "lorem " * 50000 + "apache license version 2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("label", F.lit("z"))
    got = [tuple(r) for r in scan_licenses(df).select(*COLS).collect()]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert len(by[4]) == 2 and by[4][0] == by[4][1]
    for doc, text in rows:
        w = template_words(text or "")
        at = [(i, k) for k, p in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = by[doc][0]
        assert r[1:6] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at})))
    assert by[6][0][6] == "gpl-3" and by[6][0][7] > 0.7 and by[7][0][6:] == ("", 0.0)
    assert scan_licenses(df.limit(0)).count() == 0


def test_licenses_of_similar_wording(spark):
    cc = "This work is licensed under a Creative Commons {} 4.0 International License"
    gnu = "either expressed or implied. It is licensed under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. See below"
    rows = [(f"cc-{k}", "see here: " + cc.format(v) + ", thanks.") for k, v in _CC.items()] + [(f"cc-{k}", f"Licensed under CC {k.upper()} 4.0") for k in _CC]
    rows += [(k, "This program is free software: you can redistribute it and/or modify it " + gnu.format(*v)) for k, v in _GNU.items()] + [(k, "This work is licensed under the GNU {} Public License, version {}.".format(*v)) for k, v in _GNU.items()]
    rows += [("apache-1.1", "Licensed under the Apache License, Version 1.1"), ("apache-2", "Licensed under the Apache License, Version 2.0"), ("", "This work is licensed under the GNU Free Documentation License, version 1.3."), ("", "Licensed under the Apache License")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) - set(r.base_labels.split(",")) - {""} for r in scan_licenses(df).collect()}
    base = {r.doc_id: set(r.base_labels.split(",")) - {""} for r in scan_licenses(df).collect()}
    assert {i: got[i] | base[i] for i in got} == {i: {want} - {""} | base[i] for i, (want, _) in enumerate(rows)}
    assert [r.labels for r in scan_licenses(spark.createDataFrame([(1, cc.format("Attribution-NonCommercial") + ". Released under the MIT License. " + cc.format("Attribution"))], "doc_id long, text string")).collect()] == ["cc-by,cc-by-nc,mit"]
