import datetime

import numpy as np

from weir.functions import inference as I
from weir.functions import kernels as K
from weir.plans import catalog


def test_population_queries_do_the_whole_work(spark, tmp_path):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(0, 1, 40).tolist(), "b": r.normal(1.2, 1, 40).tolist()}
    day = {"a": datetime.datetime(2024, 1, 10), "b": datetime.datetime(2024, 1, 20)}
    rows = [(i, day[k], 10, "error", v) for k in groups for i, v in enumerate(groups[k])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    run = {n: [x.asDict() for x in catalog.queries()[n](spark, str(tmp_path)).collect()] for n in ("mc_power", "perm_test", "mcb")}
    assert len(run["mc_power"]) == 1 and 7 <= run["mc_power"][0]["runs"] <= 20
    assert np.isclose(run["perm_test"][0]["p"], 1 / 2001)
    want = I.compare_with_best({k: sorted(v) for k, v in groups.items()}, 2000, I.fnv1a(1, "mcb", 0))
    assert all(np.allclose((x["lo"], x["hi"]), want[x["axis"]]) for x in run["mcb"]) and len(run["mcb"]) == 2


def test_power_is_zero_without_variance_and_counts_no_draw_without_it():
    assert I.power([1, 1], [2, 2]) == 0 and I.power([1, 1, 1], [1, 1, 1]) == 0


def test_graphs_hold_512_distinct_vectors_and_all_their_rows(spark, tmp_path):
    r = np.random.default_rng(6)
    distinct = r.normal(0, 1, (600, 4)).astype(np.float32)
    v = np.concatenate([distinct, np.repeat(distinct[:2], 100, axis=0)])
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x = distinct.astype(float)
    near = np.argsort(((x - x[0]) ** 2).sum(axis=1), kind="stable")[:512]
    w = K.affinity(x[near], 7)
    resistance = dict(zip(near.tolist(), K.effective_resistance(w)[0]))
    resistance |= {600 + i: resistance[i // 100] for i in range(200) if i // 100 in resistance}
    q = catalog.queries()
    got = {a.vec_id: a.resistance for a in q["effective_resistance"](spark, str(tmp_path)).collect()}
    assert got.keys() == resistance.keys() and all(np.isclose(got[i], resistance[i], atol=1e-6) for i in got)
    one = q["fiedler"](spark, str(tmp_path)).collect()
    want = K.fiedler(w)
    assert len(one) == 1 and np.isclose(one[0].connectivity, want[0]) and one[0].parts == want[1]
    cluster = {a.vec_id: a.cluster for a in q["spectral_cluster"](spark, str(tmp_path)).collect()}
    assert cluster.keys() == resistance.keys() and len({cluster[0], *(cluster[600 + i] for i in range(100))}) == 1


def test_graph_of_a_small_table(spark):
    d = "/root/testdata/sf0.01"
    assert catalog.queries()["spectral_cluster"](spark, d).count() == spark.read.parquet(f"{d}/embeddings.parquet").count()
