"""Queries: anomaly, graph, signal and population kernels by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.functions import disorder as D
from weir.functions import inference as I
from weir.functions import kernels as K
from weir.operators import stream as S
from weir.operators import windows as W
from weir.plans.registry import query
from weir.plans.sequence import events
from weir.session import table
from weir.sources import prometheus as P


def by_group(df, by, kernel, schema):
    """kernel(pandas frame of a group) for each group, whose rows must fit one task: the caller bounds them."""
    return df.groupBy(*by).applyInPandas(kernel, schema)


def _by_type(spark, sf, fields, kernel):
    """kernel(values of an event type of a user, in order) -> a dict with the fields."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["us", "event_id"])
        return pd.DataFrame([{"user_id": int(g.user_id.iloc[0]), **kernel(g.value.to_numpy(float))}])

    return by_group(events(spark, sf), ["user_id"], run, f"user_id long, {fields}")


@query("classify")
def classify(spark, sf):
    fields = "cls string, runs long, inversion double, lis long, lds long, distinct double, phase long, bound double, interleave long"
    return _by_type(spark, sf, fields, lambda v: {k: x for k, x in D.classify(v).items() if k not in ("mono", "longest", "rotation")})


@query("randomness")
def randomness(spark, sf):
    return _by_type(spark, sf, ", ".join(f"{x} double" for x in D.LENSES) + ", n long, k long, verdict string, confidence double", D.randomness)


@query("characterize")
def characterize(spark, sf):
    return _by_type(spark, sf, "cls string, rand_confidence double, n long, info_bound double", D.characterize)


@query("locate")
def locate(spark, sf):
    """Windows of 16 of each user's values that are of a class, by steps of 8."""
    return W.profile(events(spark, sf), "value", ["us", "event_id"], ["user_id"], window=16, stride=8).select("user_id", "start", "cls", "inversion", "distinct")


@query("locate_values")
def locate_values(spark, sf):
    """The values, each once, that windows in random order cover, of the whole event stream as one sequence."""
    return W.locate_values(events(spark, sf), "value", ["us", "event_id"], [], "RANDOM", window=64, stride=16).select("n", "value")


_Z = """WITH m AS (SELECT l_returnflag AS f, median(l_quantity) AS mq, median(l_tax) AS mt FROM lineitem GROUP BY 1),
d AS (SELECT l_orderkey, l_linenumber, f, abs(l_quantity - mq) AS dq, abs(l_tax - mt) AS dt FROM lineitem JOIN m ON f = l_returnflag),
s AS (SELECT f, median(dq) / 0.6745 AS sq, median(dt) / 0.6745 AS st FROM d GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(greatest(dq / sq, dt / st), 6) AS score FROM d JOIN s USING (f)"""


@query("mad_score", _Z)
def mad(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"), "l_quantity", "l_tax")
    m = S.medians_by(li, ["f"], "l_quantity", "mq").join(S.medians_by(li, ["f"], "l_tax", "mt"), "f")
    d = li.join(F.broadcast(m), "f").select("l_orderkey", "l_linenumber", "f", F.abs(F.col("l_quantity") - F.col("mq")).alias("dq"), F.abs(F.col("l_tax") - F.col("mt")).alias("dt"))
    s = S.medians_by(d, ["f"], "dq", "sq").join(S.medians_by(d, ["f"], "dt", "st"), "f").select("f", (F.col("sq") / 0.6745).alias("sq"), (F.col("st") / 0.6745).alias("st"))
    return d.join(F.broadcast(s), "f").select("l_orderkey", "l_linenumber", F.round(F.greatest(F.col("dq") / F.col("sq"), F.col("dt") / F.col("st")), 6).alias("score"))


def _features(spark, sf):
    """A row of counts and values for each user."""
    e = events(spark, sf)
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).cast("double").alias(t) for t in ("click", "error", "purchase", "view")), F.avg("value").alias("mean"), F.max("value").alias("peak")).withColumn("shard", F.lit(0))


def _scores(name, kernel):
    @query(name)
    def run(spark, sf):
        def one(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("user_id")
            return pd.DataFrame({"user_id": g.user_id, **kernel(g[["click", "error", "purchase", "view", "mean", "peak"]].to_numpy(float))})

        # One population of a few hundred rows, as a process table is.
        fields = "score double, axis long" if name == "anomaly_fuse" else "score double"
        return by_group(_features(spark, sf), ["shard"], one, f"user_id long, {fields}")


_scores("mahalanobis", lambda x: {"score": K.mahalanobis(K.standardize(x))})
_scores("half_space_trees", lambda x: {"score": K.half_space_trees(x)})
_scores("anomaly_fuse", lambda x: dict(zip(("score", "axis"), K.anomaly_fuse(x))))


_LAST = "(SELECT user_id, list(value ORDER BY us, event_id)[-64:] AS v FROM (SELECT user_id, event_id, epoch_us(ts) AS us, value FROM events) GROUP BY user_id)"


@query("changepoint_ewma", f"SELECT user_id, round(CASE WHEN len(v) < 8 THEN 0 ELSE coalesce(abs(list_reduce(v, lambda s, x: s + 0.4 * (x - s)) - list_reduce(v, lambda s, x: s + 0.06 * (x - s))) / nullif(list_aggregate(v, 'stddev_pop'), 0), 0) END, 6) AS score FROM {_LAST}")
def changepoint(spark, sf):
    """Divergence of a fast and a slow average of a user's last 64 values (its window), in standard deviations."""
    last = S.first_n_by(events(spark, sf), 64, ["user_id"], [F.desc("us"), F.desc("event_id")])
    s = last.groupBy("user_id").agg(F.stddev_pop("value").alias("sd"), F.transform(F.array_sort(F.collect_list(F.struct("us", "event_id", "value"))), lambda x: x["value"]).alias("v"))
    mean = lambda a: F.aggregate(F.expr("slice(v, 2, greatest(size(v) - 1, 0))"), F.col("v")[0], lambda m, x: m + F.lit(a) * (x - m))
    score = F.when(F.size("v") < 8, 0.0).otherwise(F.coalesce(F.abs(mean(0.4) - mean(0.06)) / F.nullif(F.col("sd"), F.lit(0.0)), F.lit(0.0)))
    return s.select("user_id", F.round(score, 6).alias("score"))


def _saliency(v: np.ndarray) -> dict:
    """Peaks and greatest saliency over the first and the last window of a power of two, which together cover a series; what lies in both counts in the first."""
    n = 1 << (len(v).bit_length() - 1)
    if n < 4:
        return {"peaks": 0, "top": 0.0, "looked": len(v)}
    s, f = K.spectral_residual(v[:n])
    peaks, top = int(f.sum()), float(s.max())
    if rest := len(v) - n:
        s, f = K.spectral_residual(v[-n:])
        peaks, top = peaks + int(f[-rest:].sum()), max(top, float(s[-rest:].max()))
    return {"peaks": peaks, "top": top, "looked": len(v)}


@query("spectral_residual")
def residual(spark, sf):
    return _by_type(spark, sf, "peaks long, top double, looked long", _saliency)


@query("matrix_profile")
def profile(spark, sf):
    """Each user's window of 8 values that is farthest from its nearest other one; -1 for users of fewer than 24 values."""
    e = events(spark, sf)
    far = W.matrix_profile(e, "value", ["us", "event_id"], ["user_id"], 8).groupBy("user_id").agg(F.max_by(F.struct("distance", "start"), F.struct("distance", -F.col("start"))).alias("d"))
    users = e.where("value is not null").groupBy("user_id").agg((F.count("*") >= 24).alias("enough")).join(far, "user_id", "left")
    return users.select("user_id", F.coalesce(F.when(F.col("enough"), F.col("d.distance")), F.lit(0.0)).alias("discord"), F.coalesce(F.when(F.col("enough"), F.col("d.start")), F.lit(-1)).cast("long").alias("at"))


@query("dfa_hurst")
def dfa(spark, sf):
    return _by_type(spark, sf, "hurst double, se double, rs double", lambda v: {**dict(zip(("hurst", "se"), K.hurst_dfa(v))), "rs": K.hurst_rs(v)})


def _nearest(spark, sf, n):
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = v.where("vec_id = 0").select(F.col("v").alias("q"))
    d = F.expr("aggregate(zip_with(v, q, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)")
    return v.join(F.broadcast(q)).withColumn("d", d).orderBy("d", "vec_id").limit(n).select("vec_id", "label", "v", "d")


@query("similar_neighbors", "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))), 5) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def similar(spark, sf):
    return _nearest(spark, sf, 20).select("vec_id", F.round(F.sqrt("d"), 5).alias("distance"))


#: Distinct vectors of a graph at most: its kernels are cubic in the nodes.
NODES = 512


def _graph(name, fields, kernel, members=True):
    """kernel(affinities of the distinct vectors nearest to that of vec_id 0, itself first), with members for each row of those vectors."""
    @query(name)
    def run(spark, sf):
        def one(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["d", "first"])
            out = kernel(K.affinity(np.array(g.v.tolist(), float), min(7, len(g) - 1)))
            return out.assign(v=g.v.tolist()) if members else out

        e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
        q = e.where("vec_id = 0").select(F.col("v").alias("q"))
        d = F.expr("aggregate(zip_with(v, q, (a, b) -> (double(a) - double(b)) * (double(a) - double(b))), 0D, (s, x) -> s + x)")
        nodes = e.groupBy("v").agg(F.min("vec_id").alias("first")).join(F.broadcast(q)).withColumn("d", d).orderBy("d", "first").limit(NODES)
        nodes = nodes.select("first", "v", "d", F.lit(0).alias("shard"))
        if not members:
            return by_group(nodes, ["shard"], one, fields)
        out = by_group(nodes, ["shard"], one, f"{fields}, v array<float>")
        return e.join(F.broadcast(out), "v").select("vec_id", *out.drop("v").columns)


_graph("effective_resistance", "resistance double", lambda w: pd.DataFrame({"resistance": K.effective_resistance(w)[0]}))
_graph("spectral_cluster", "cluster long", lambda w: pd.DataFrame({"cluster": K.spectral_cluster(w, 3).astype("int64")}))
_graph("fiedler", "connectivity double, parts long", lambda w: pd.DataFrame([dict(zip(("connectivity", "parts"), K.fiedler(w)))]), members=False)


# -- populations ------------------------------------------------------------

_CELLS = "(SELECT user_id % 10 AS cell, CASE WHEN epoch_us(ts) < epoch_us(TIMESTAMP '2024-01-16') THEN 'a' ELSE 'b' END AS axis, value FROM events WHERE event_type = 'error')"


def _cells(spark, sf):
    e = events(spark, sf).where("event_type = 'error'")
    return e.select((F.col("user_id") % 10).alias("cell"), F.when(F.col("us") < 1705363200000000, "a").otherwise("b").alias("axis"), "value")


@query("cliffs_delta", f"SELECT x.cell, round(avg(sign(x.value - y.value)), 6) AS delta FROM {_CELLS} x JOIN {_CELLS} y ON x.cell = y.cell AND x.axis = 'a' AND y.axis = 'b' GROUP BY 1")
def cliffs(spark, sf):
    # Ranks in place of pairs: linear in a cell's samples.
    w = Window.partitionBy("cell").orderBy("value")
    c = _cells(spark, sf).groupBy("cell", "value").agg(F.count_if(F.col("axis") == "a").alias("a"), F.count_if(F.col("axis") == "b").alias("b"))
    c = c.withColumn("upto", F.sum("b").over(w)).withColumn("all", F.sum("b").over(Window.partitionBy("cell")))
    d = F.sum(F.col("a") * (F.col("upto") - F.col("b") - (F.col("all") - F.col("upto")))) / (F.sum("a") * F.first("all"))
    return c.groupBy("cell").agg(F.round(d, 6).alias("delta"))


_BOUNDS = (50000, 100000, 200000)


@query("hist_reconstruct", "WITH b AS (SELECT o_orderstatus AS file, le, count(*) FILTER (WHERE o_totalprice <= le) AS upto FROM orders, (VALUES (50000.0::DOUBLE), (100000), (200000), ('inf'::DOUBLE)) t(le) GROUP BY 1, 2), d AS (SELECT file, le, coalesce(lag(le) OVER w, 0) AS lo, upto - coalesce(lag(upto) OVER w, 0) AS n FROM b WINDOW w AS (PARTITION BY file ORDER BY le)) SELECT file, round(CASE WHEN isinf(le) THEN lo WHEN lo > 0 THEN sqrt(lo * le) ELSE le / 2 END, 6) AS midpoint, n FROM d WHERE n > 0")
def hist(spark, sf):
    """Prices as a cumulative histogram of an archive, taken apart again."""
    from weir.sources import prometheus

    le = F.array(*(F.struct(F.lit(float(x)).alias("at"), F.lit(str(x)).alias("le")) for x in _BOUNDS), F.struct(F.lit(float("inf")).alias("at"), F.lit("+Inf").alias("le")))
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("file"), "o_totalprice", F.explode(le).alias("b"))
    made = o.groupBy("file", "b").agg(F.count_if(F.col("o_totalprice") <= F.col("b.at")).cast("double").alias("value"))
    made = made.select("file", F.lit("price_bucket").alias("name"), F.create_map(F.lit("le"), F.col("b.le")).alias("labels"), "value")
    return prometheus.histogram_samples(made).select("file", F.round("midpoint", 6).alias("midpoint"), "n")


@query("l2_share_busy", "WITH s AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS scrape, user_id % 8 AS cpu, sum(value) AS v FROM events GROUP BY 1, 2), b AS (SELECT scrape, sum(v) AS total FROM s GROUP BY 1), k AS (SELECT scrape FROM b WHERE total > 0.3 * (SELECT max(total) FROM b)) SELECT cpu, round(sum(v) / (SELECT sum(v) FROM s WHERE scrape IN (SELECT scrape FROM k)), 6) AS share FROM s WHERE scrape IN (SELECT scrape FROM k) GROUP BY 1")
def l2_share(spark, sf):
    s = events(spark, sf).groupBy(F.floor(F.col("us") / 3600000000).alias("scrape"), (F.col("user_id") % 8).alias("cpu")).agg(F.sum("value").alias("v"))
    b = s.groupBy("scrape").agg(F.sum("v").alias("total"))
    k = b.join(F.broadcast(b.agg(F.max("total").alias("peak")))).where("total > 0.3 * peak").select("scrape")
    busy = s.join(k, "scrape")
    c = busy.groupBy("cpu").agg(F.sum("v").alias("v"))
    return c.join(F.broadcast(c.agg(F.sum("v").alias("all")))).select("cpu", F.round(F.col("v") / F.col("all"), 6).alias("share"))


def _compare(name, fields, kernel):
    @query(name)
    def run(spark, sf):
        def one(g: pd.DataFrame) -> pd.DataFrame:
            cell = int(g.cell.iloc[0])
            groups = {k: sorted(x.value.tolist()) for k, x in g.groupby("axis")}
            return pd.DataFrame([{"cell": cell, **r} for r in kernel(groups, I.fnv1a(1, name, cell))])

        return by_group(_cells(spark, sf), ["cell"], one, f"cell long, {fields}")


_compare("perm_test", "p double", lambda g, s: [{"p": I.permutation_test(g["a"], g["b"], seed=s)}] if len(g) == 2 else [])
_compare("welch_t", "t double, df double, p double", lambda g, s: [dict(zip(("t", "df", "p"), I.welch(g["a"], g["b"])))] if len(g) == 2 else [])
_compare("games_howell", "a string, b string, p double", lambda g, s: [dict(zip("abp", r)) for r in I.games_howell(g)])
_compare("mcb", "axis string, lo double, hi double", lambda g, s: [{"axis": k, "lo": float(a), "hi": float(b)} for k, (a, b) in I.compare_with_best(g, seed=s).items()])
_compare("mc_power", "runs long", lambda g, s: [{"runs": I.power(g["a"], g["b"], seed=s)}] if len(g) == 2 else [])


_MOMENTS = f"m AS (SELECT cell, axis, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM {_CELLS} GROUP BY 1, 2)"


@query("welch_stats", f"WITH {_MOMENTS} SELECT a.cell, round((a.mean - b.mean) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) AS df FROM m a JOIN m b USING (cell) WHERE a.axis = 'a' AND b.axis = 'b'")
def welch_stats(spark, sf):
    m = _cells(spark, sf).groupBy("cell").pivot("axis", ["a", "b"]).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("v"))
    a, b = F.col("a_v") / F.col("a_n"), F.col("b_v") / F.col("b_n")
    t = (F.col("a_mean") - F.col("b_mean")) / F.sqrt(a + b)
    return m.select("cell", F.round(t, 6).alias("t"), F.round(F.pow(a + b, F.lit(2.0)) / (a * a / (F.col("a_n") - 1) + b * b / (F.col("b_n") - 1)), 6).alias("df"))


_LEVELS = "l AS (SELECT level, place, mean, min(place) FILTER (WHERE mean = low) OVER () AS best FROM (SELECT *, min(mean) OVER () AS low FROM (SELECT strftime(ts, '%Y-%m-%d') AS level, row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%d')) AS place, avg(value) AS mean FROM events WHERE event_type = 'error' GROUP BY 1)))"


def _pairs(mode, where):
    @query(f"pairs_{mode}", f"WITH {_LEVELS} SELECT x.level AS a, y.level AS b, round(y.mean - x.mean, 6) AS change FROM l x JOIN l y ON {where}")
    def run(spark, sf):
        e = events(spark, sf).where("event_type = 'error'")
        day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
        return I.level_pairs(e.groupBy(day.alias("level")).agg(F.avg("value").alias("mean")), mode)


_pairs("adjacent", "y.place = x.place + 1")
_pairs("all", "y.place > x.place")
_pairs("vs_best", "x.place = x.best AND y.place <> x.place")


@query("metric_filter", "SELECT CASE p_brand WHEN 'Brand#3' THEN 'first' ELSE p_brand END AS brand, count(*) AS n FROM part WHERE contains(p_type, 'S') GROUP BY 1")
def metric_filter(spark, sf):
    p = table(spark, sf, "part").where(F.contains("p_type", F.lit("S")))
    alias = F.coalesce(F.create_map(F.lit("Brand#3"), F.lit("first"))[F.col("p_brand")], F.col("p_brand"))
    return p.groupBy(alias.alias("brand")).agg(F.count("*").alias("n"))


@query("system_digest", "SELECT user_id % 8 AS host, arg_max(value, (epoch_us(ts), event_id)) FILTER (WHERE event_type = 'view') AS last_view, max(value) FILTER (WHERE event_type = 'error') AS peak_error, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS mean_error, CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS restarts FROM events GROUP BY 1")
def system_digest(spark, sf):
    """A line a host: the last of one family, peak and mean of another, and how often it restarted."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    view = F.when(F.col("event_type") == "view", F.struct("us", "event_id"))
    return events(spark, sf).groupBy((F.col("user_id") % 8).alias("host")).agg(F.max_by("value", view).alias("last_view"), F.max(of("error")).alias("peak_error"), F.round(F.avg(of("error")), 6).alias("mean_error"), F.count_if(F.col("event_type") == "signup").alias("restarts"))


@query("trajectory")
def trajectory(spark, sf):
    def changes(v: np.ndarray) -> dict:
        return {"changes": len(I.trajectory([x.tolist() for x in np.array_split(v, 6)], seed=3))}

    return _by_type(spark, sf, "changes long", changes)


_FAMILIES = "replace(p_name, ' ', '_') || '_' || lower(p_type) || '_p99'"


@query("family_prefixes", f"""WITH g AS (SELECT DISTINCT {_FAMILIES} AS metric FROM part), h AS (SELECT DISTINCT replace(p_name, ' ', '_') AS prefix FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part)
SELECT metric, arg_max(prefix, length(prefix)) AS prefix FROM g JOIN h ON starts_with(metric, prefix || '_') AND length(metric) > length(prefix) + 1 GROUP BY metric""")
def family_prefixes(spark, sf):
    """Families named after parts, each with the longest other family that its name extends."""
    part = table(spark, sf, "part")
    named = F.translate("p_name", " ", "_")
    gauges = part.select(F.concat(named, F.lit("_"), F.lower("p_type"), F.lit("_p99")).alias("metric"))
    return P.longest_prefix(gauges, part.where("p_size % 2 = 0").select(named.alias("metric")).union(part.select(F.split("p_name", " ")[0])))
