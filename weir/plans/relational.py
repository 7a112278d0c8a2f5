"""Queries: joins, sets, runs, head and tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.operators import stream as S
from weir.plans.registry import query
from weir.session import table


@query("join_first_match", "SELECT c.c_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM customer c JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON o.o_custkey = c.c_custkey AND o.r = 1")
def join_first(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return S.join_first(table(spark, sf, "customer").select("c_custkey", "c_name"), o, "c_custkey", "o_orderkey")


def _sides(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 997).cast("string").alias("line"), "event_type")
    return e.where("event_type = 'click'"), e.where("event_type = 'purchase'")


_L, _R = ("SELECT event_id, CAST(event_id %% 997 AS VARCHAR) AS line FROM events WHERE event_type = '%s'" % t for t in ("click", "purchase"))


@query("set_intersect", f"SELECT line, min(event_id) AS event_id FROM ({_L}) WHERE line IN (SELECT line FROM ({_R})) GROUP BY line")
def intersect(spark, sf):
    return S.intersect(*_sides(spark, sf), "line", "event_id")


@query("set_subtract", f"SELECT line, min(event_id) AS event_id FROM ({_L}) WHERE line NOT IN (SELECT line FROM ({_R})) GROUP BY line")
def subtract(spark, sf):
    return S.subtract(*_sides(spark, sf), "line", "event_id")


@query("set_union", f"SELECT line, min(side) AS side, coalesce(min(event_id) FILTER (WHERE side = 0), min(event_id)) AS event_id FROM (SELECT *, 0 AS side FROM ({_L}) UNION ALL SELECT *, 1 FROM ({_R})) GROUP BY line")
def union(spark, sf):
    return S.union(*_sides(spark, sf), "line", "event_id")


@query("comm_three_way", f"SELECT line, greatest(coalesce(l, 0) - coalesce(r, 0), 0) AS only_left, greatest(coalesce(r, 0) - coalesce(l, 0), 0) AS only_right, least(coalesce(l, 0), coalesce(r, 0)) AS both FROM (SELECT line, count(*) AS l FROM ({_L}) GROUP BY line) FULL JOIN (SELECT line, count(*) AS r FROM ({_R}) GROUP BY line) USING (line)")
def comm(spark, sf):
    return S.comm(*_sides(spark, sf), "line")


@query("paste_zip", "SELECT k AS line_no, coalesce(s_name, '') || chr(9) || coalesce(n_name, '') AS line FROM (SELECT s_suppkey AS k, s_name FROM supplier) FULL JOIN (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation) USING (k)")
def paste_zip(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("line_no"), F.col("s_name").alias("line"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("line_no"), F.col("n_name").alias("line"))
    return S.paste(a, b, "line_no")


@query("paste_serial", "SELECT string_agg(n_name, chr(9) ORDER BY n_nationkey) AS line FROM nation")
def paste_serial(spark, sf):
    return table(spark, sf, "nation").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\t").alias("line"))


_RUNS = """WITH c AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run"""


def _uniq(name, keep, having):
    @query(name, f"{_RUNS} {having}")
    def run(spark, sf):
        return S.uniq(table(spark, sf, "events"), "event_type", ["ts", "event_id"], ["user_id"], keep)


_uniq("uniq_adjacent", "all", "")
_uniq("uniq_d", "repeated", "HAVING count(*) > 1")
_uniq("uniq_u", "single", "HAVING count(*) = 1")


@query("tac", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations")
def tac(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))).cast("long").alias("place"))


@query("head", "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 20")
def head(spark, sf):
    return table(spark, sf, "events").orderBy("ts", "event_id").limit(20).select("event_id", "event_type")


@query("tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def tail(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type")
