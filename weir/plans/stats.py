"""Queries: grouped and global aggregates, order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.functions import text as T
from weir.operators import stream as S
from weir.plans.registry import query
from weir.session import table

_GROUP = {
    "sum": "round(sum(v), 4)", "mean": "round(avg(v), 6)", "count": "count(*)", "min": "min(v)", "max": "max(v)",
    "sstdev": "CASE WHEN count(v) = 1 THEN CAST('nan' AS DOUBLE) ELSE round(stddev_samp(v), 6) END", "pstdev": "round(stddev_pop(v), 6)",
    "median": "median(v)", "countunique": "count(DISTINCT v)",
}


def _group(op, sql):
    @query(f"group_{op}", f"SELECT l_returnflag AS key, {sql} AS value FROM (SELECT l_returnflag, l_quantity AS v FROM lineitem) GROUP BY 1")
    def run(spark, sf):
        out = S.group(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", op, "l_quantity")
        digits = {"sum": 4, "mean": 6, "sstdev": 6, "pstdev": 6}.get(op)
        v = F.col("value")
        v = F.when(F.isnan(v), v).otherwise(F.round(v, digits)) if digits else v
        return out.select(F.col("l_returnflag").alias("key"), v.alias("value"))


for _op, _sql in _GROUP.items():
    _group(_op, _sql)

_TEXT = {
    "first": "arg_min(event_type, event_id)", "last": "arg_max(event_type, event_id)",
    "unique": "array_to_string(list_sort(list_distinct(list(event_type))), ',')", "collapse": "string_agg(event_type, ',' ORDER BY event_id)",
}


def _text_group(op, sql):
    @query(f"group_{op}", f"SELECT user_id AS key, {sql} AS value FROM events GROUP BY 1")
    def run(spark, sf):
        return S.group(table(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", op, "event_type", "event_id").select(F.col("user_id").alias("key"), "value")


for _op, _sql in _TEXT.items():
    _text_group(_op, _sql)


def _mode(op, direction):
    @query(f"group_{op}", f"SELECT key, value FROM (SELECT user_id AS key, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY count(*) {direction}, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
    def run(spark, sf):
        return S.group(table(spark, sf, "events").select("user_id", "event_type"), "user_id", op, "event_type").select(F.col("user_id").alias("key"), "value")


_mode("mode", "DESC")
_mode("antimode", "ASC")


@query("sum_mean_min_max", "SELECT round(sum(l_extendedprice), 2) AS s, round(avg(l_extendedprice), 6) AS m, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem")
def sum_mean(spark, sf):
    v = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").agg(F.round(F.sum(v), 2).alias("s"), F.round(F.avg(v), 6).alias("m"), F.min(v).alias("lo"), F.max(v).alias("hi"))


@query("stdev_variance", "SELECT round(coalesce(stddev_samp(value), 0), 5) AS sd, round(coalesce(var_samp(value), 0), 4) AS var FROM events")
def stdev(spark, sf):
    return table(spark, sf, "events").agg(F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 5).alias("sd"), F.round(F.coalesce(F.var_samp("value"), F.lit(0.0)), 4).alias("var"))


@query("column_moments", "SELECT round(avg(l_tax), 8) AS mean, round(var_pop(l_tax), 10) AS var, round(covar_pop(l_tax, l_discount), 8) AS cov FROM lineitem")
def moments(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.avg("l_tax"), 8).alias("mean"), F.round(F.var_pop("l_tax"), 10).alias("var"), F.round(F.covar_pop("l_tax", "l_discount"), 8).alias("cov"))


@query("distinct", "SELECT count(DISTINCT p_type) AS n FROM part")
def distinct(spark, sf):
    return table(spark, sf, "part").agg(F.count_distinct("p_type").alias("n"))


@query("tally", "SELECT event_type AS token, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, token")
def tally(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("token")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token")


_FLOOR = "SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {t}) WHERE r = least(CAST(floor({q} * n) AS BIGINT) + 1, n)"


def _at(df, value, index):
    n = df.agg(F.count(value)).first()[0]
    return S.order_statistics(df, value, [index(n)], n).select("value")


def _quantile(name, q, t, c, index, sql):
    @query(name, f"SELECT v AS value FROM ({sql})")
    def run(spark, sf):
        return _at(table(spark, sf, t).select(c), c, index)


_quantile("quantile_floor", 0.99, "lineitem", "l_extendedprice", lambda n: S.floor_index(0.99, n), _FLOOR.format(c="l_extendedprice", t="lineitem", q=0.99))
_quantile("quantile_nearest", 0.25, "events", "value", lambda n: S.nearest_index(0.25, n), "SELECT quantile_disc(value, 0.25) AS v FROM events")
_quantile("select_k", 0, "orders", "o_totalprice", lambda n: 500, "SELECT v FROM (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS r FROM orders) WHERE r = 501")


@query("quantile_linear", "SELECT round(quantile_cont(o_totalprice, 0.9), 6) AS value FROM orders")
def quantile_linear(spark, sf):
    return table(spark, sf, "orders").agg(F.round(F.percentile("o_totalprice", 0.9), 6).alias("value"))


@query("searchsorted", "SELECT count(*) FILTER (WHERE o_totalprice < 100000) AS lower_bound, count(*) FILTER (WHERE o_totalprice <= 100000) AS upper_bound FROM orders")
def searchsorted(spark, sf):
    return table(spark, sf, "orders").agg(F.count_if(F.col("o_totalprice") < 100000).alias("lower_bound"), F.count_if(F.col("o_totalprice") <= 100000).alias("upper_bound"))


_RANKED = "WITH r AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {t})"
_Q = ", ".join(f"max(v) FILTER (WHERE r = least(CAST(floor({q} * n) AS BIGINT) + 1, n)) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75))


@query("describe", f"{_RANKED.format(c='value', t='events')} SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stdev, min(v) AS lo, {_Q}, max(v) AS hi FROM r")
def describe(spark, sf):
    e = table(spark, sf, "events").select("value")
    n = e.agg(F.count("value")).first()[0]
    q = S.order_statistics(e, "value", [S.floor_index(x, n) for x in (0.25, 0.5, 0.75)], n).agg(*(F.max(F.when(F.col("rank") == S.floor_index(x, n), F.col("value"))).alias(f"q{int(x * 100)}") for x in (0.25, 0.5, 0.75)))
    a = e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("stdev"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return a.join(F.broadcast(q)).select("n", "mean", "stdev", "lo", "q25", "q50", "q75", "hi")


@query("outliers_tukey", f"{_RANKED.format(c='value', t='events')}, q AS (SELECT {_Q} FROM r) SELECT event_id, value FROM events, q WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)")
def outliers(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    n = e.agg(F.count("value")).first()[0]
    lo, hi = (r.value for r in S.order_statistics(e, "value", [S.floor_index(x, n) for x in (0.25, 0.75)], n).orderBy("rank").collect())
    return e.where((F.col("value") < lo - 1.5 * (hi - lo)) | (F.col("value") > hi + 1.5 * (hi - lo)))


@query("histogram_10", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT range AS bin, coalesce(n, 0) AS count FROM range(10) LEFT JOIN c ON c.bin = range")
def histogram(spark, sf):
    return S.histogram(table(spark, sf, "events"), "value")


@query("sort_keyed_multi", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey) AS place FROM orders")
def sort_keyed(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), F.desc("o_custkey"), "o_orderkey")).cast("long").alias("place"))


@query("sort_human", "SELECT p_partkey, CAST(p_size * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1024.0 ELSE 1048576.0 END AS DOUBLE) AS v FROM part ORDER BY v DESC, p_partkey LIMIT 50")
def sort_human(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("m")), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("s"))
    return p.select("p_partkey", T.human_number(F.col("s")).alias("v")).orderBy(F.desc("v"), "p_partkey").limit(50)


@query("topk", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk(spark, sf):
    return table(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


@query("offender_rank", "SELECT event_type, event_id, round(CASE WHEN count(*) OVER (PARTITION BY event_type) = 1 THEN 1.0 ELSE percent_rank() OVER (PARTITION BY event_type ORDER BY value) END, 6) AS norm FROM events")
def offender_rank(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    return table(spark, sf, "events").select("event_type", "event_id", F.round(F.when(F.count("*").over(w) == 1, 1.0).otherwise(F.percent_rank().over(w.orderBy("value"))), 6).alias("norm"))


@query("tied_rank", "SELECT l_orderkey, l_linenumber, rank() OVER w + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS mid_rank FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)")
def tied_rank(spark, sf):
    """Mean ranks of equal values, from counts by value: no task sorts a group's rows."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    c = li.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.partitionBy("l_returnflag").orderBy("l_quantity")) - F.col("n")
    return li.join(c.select("l_returnflag", "l_quantity", (below + (F.col("n") + 1) / 2).alias("mid_rank")), ["l_returnflag", "l_quantity"]).select("l_orderkey", "l_linenumber", "mid_rank")


@query("sort_strings", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
def sort_strings(spark, sf):
    """Places in byte order, from counts by first letters and an order inside each: no task sorts all strings."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.substring(F.encode("p_name", "UTF-8"), 1, 2).alias("head"))
    before = p.groupBy("head").agg(F.count("*").alias("n")).select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("head").orderBy(F.encode("p_name", "UTF-8"), "p_partkey"))
    return p.join(before, "head").select("p_partkey", (F.col("before") + inside).alias("place"))


@query("process_sort_modes", " UNION ALL ".join(f"(SELECT '{m}' AS mode, s_suppkey, CAST(row_number() OVER (ORDER BY {o}, s_suppkey) AS INTEGER) AS place FROM supplier ORDER BY {o}, s_suppkey LIMIT 20)" for m, o in (("cpu", "s_acctbal DESC"), ("pid", "s_suppkey"), ("name", "s_name"), ("memory", "s_nationkey DESC"))))
def process_sort_modes(spark, sf):
    """The first rows of a process table under each of its orders; a limit, as a table has so many lines."""
    s, out = table(spark, sf, "supplier"), None
    for mode, order in (("cpu", F.desc("s_acctbal")), ("pid", F.asc("s_suppkey")), ("name", F.asc("s_name")), ("memory", F.desc("s_nationkey"))):
        place = F.row_number().over(Window.orderBy(order, "s_suppkey")).cast("int")
        top = s.orderBy(order, "s_suppkey").limit(20).select(F.lit(mode).alias("mode"), "s_suppkey", place.alias("place"))
        out = top if out is None else out.union(top)
    return out


@query("cpu_scale", "SELECT l_suppkey, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 6) AS machine_pct, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem) * (SELECT count(DISTINCT l_linenumber) FROM lineitem), 6) AS core_pct FROM lineitem GROUP BY l_suppkey")
def cpu_scale(spark, sf):
    """A process's share of the machine, and of one core: as many times that as there are cores."""
    li = table(spark, sf, "lineitem")
    whole = li.agg(F.sum("l_quantity").alias("total"), F.count_distinct("l_linenumber").alias("cores"))
    share = 100 * F.col("q") / F.col("total")
    return li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q")).join(F.broadcast(whole)).select("l_suppkey", F.round(share, 6).alias("machine_pct"), F.round(share * F.col("cores"), 6).alias("core_pct"))
