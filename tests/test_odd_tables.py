"""Queries against their SQL on rows that the given tables lack."""

import duckdb

from weir.functions import text as T
from weir.operators import temporal
from weir.plans import catalog


def differ(spark, folder, name, table, rows):
    """Rows of the query and of its SQL that the other lacks, over a table of one file made by rows (SQL)."""
    path = folder / f"{table}.parquet"
    duck = duckdb.connect()
    duck.execute(f"COPY ({rows}) TO '{path}'")
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    df = catalog.queries()[name](spark, str(folder))
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    got, want = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str), sorted(cur.fetchall(), key=str)
    assert want
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def test_human_count_beyond_a_thousand_millions(spark, tmp_path):
    keys = "0, 1, 22, 23, 707, 708, 7069, 7070, 22360, 22361, 149999, 707106, 707107, 22360680, 2000000000, -22361, NULL"
    assert differ(spark, tmp_path, "human_count", "orders", f"SELECT unnest([{keys}])::BIGINT AS o_orderkey") == ([], [], 0)


def test_human_count_of_all_units(spark):
    said = {999.0: "999", 1.7e6: "1.7M", 1.25e9: "1.2G", -3e9: "-3.0G", 2.5e12: "2.5T", 4e15: "4000T"}
    df = spark.createDataFrame([(n,) for n in said], "n double")
    assert {r.n: r.s for r in df.select("n", T.human_count(df.n).alias("s")).collect()} == said


def spans(*rows):
    """Events from (event_id, user_id, kind, start in hours, length in hours, microseconds more of length)."""
    us = "timestamp '2024-01-01' + to_microseconds({} * 3600000000::BIGINT) AS ts"
    return " UNION ALL ".join(f"SELECT {e}::BIGINT AS event_id, {us.format(at)}, {u}::BIGINT AS user_id, '{kind}' AS event_type, {n} * 6 + {more} / 6e8 AS value" for e, u, kind, at, n, more in rows)


def test_dominant_holder_of_spans_without_length(spark, tmp_path):
    # At noon, six o'clock and off them: a span without length inside a holder, a holder without length inside a span.
    rows = [(1, 1, "view", 3, 20, 0), (2, 1, "error", 12, 0, 0), (3, 1, "error", 7, 0, 0), (4, 1, "error", 3, 0, 0), (5, 1, "error", 23, 0, 0)]
    rows += [(11, 2, "error", 3, 20, 0), (12, 2, "view", 12, 0, 0), (13, 2, "view", 18, 0, 0), (14, 3, "error", 6, 0, 0), (15, 3, "view", 6, 0, 0)]
    assert differ(spark, tmp_path, "dominant_holder", "events", spans(*rows)) == ([], [], 0)


def test_dominant_holder_of_spans_that_end_before_they_start(spark, tmp_path):
    rows = [(1, 1, "view", 1, 40, 0), (2, 1, "error", 30, -20, 0), (3, 1, "error", 5, -4, 0), (11, 2, "error", 1, 40, 0), (12, 2, "view", 30, -25, 0), (13, 2, "view", 30, -2, 0)]
    assert differ(spark, tmp_path, "dominant_holder", "events", spans(*rows)) == ([], [], 0)


def test_dominant_holder_weighs_ids_far_apart(spark, tmp_path):
    # A microsecond more is worth a million of the holder's id, half a microsecond goes to the even one.
    rows = [(1, 1, "error", 0, 5, 0), (2, 1, "view", 1, 1, 0), (5000000, 1, "view", 1, 1, 1), (11, 2, "error", 0, 5, 0), (12, 2, "view", 1, 1, 0), (900000, 2, "view", 1, 1, 1)]
    rows += [(21, 3, "error", 0, 5, 0), (22, 3, "view", 1, 0, 2.5), (23, 3, "view", 1, 0, 3), ("NULL", 4, "view", 0, 5, 0), (31, 4, "error", 1, 1, 0), (32, 5, "view", 0, 1, "NULL"), (33, 5, "error", 0, 1, 0)]
    assert differ(spark, tmp_path, "dominant_holder", "events", spans(*rows)) == ([], [], 0)


def test_interval_join_of_half_microseconds(spark, tmp_path):
    rows = [(1, 1, "error", 1, 0, 2.5), (2, 1, "error", 1, 0, 3.5), (3, 1, "error", 1, 1, 0)]
    at = " UNION ALL ".join(f"SELECT {10 + k}, timestamp '2024-01-01 01:00:00' + to_microseconds({k}), 1, 'view', 0.0" for k in range(5))
    assert differ(spark, tmp_path, "interval_join_events", "events", f"{spans(*rows)} UNION ALL {at}") == ([], [], 0)


def test_dominant_holder_by_time_alone(spark):
    a = spark.createDataFrame([(1, 7, 0, 100), (2, 7, 100, 100), (3, 7, 300, 400)], "id long, k long, lo long, hi long")
    b = spark.createDataFrame([(5, 7, 0, 50), (4, 7, 50, 100), (9000000, 7, 40, 91), (8, 7, 90, 110)], "holder long, k long, blo long, bhi long")
    assert {r.id: r.holder for r in temporal.dominant_holder(a, b, ["k"], 10).collect()} == {1: 9000000, 2: 8}
