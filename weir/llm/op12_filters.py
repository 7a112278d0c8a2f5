"""Filter interaction audit: what each of five filters removes, alone and in each of their 120 orders.

All relational. Texts are dealt by document, so that words are exploded, counted by (document, word) and then by
document where they lie; flags of the other filters come from a second, narrow scan and are joined to these totals.
Rows are then counted by part and by the set of filters that they fail: 32 conditional counts a part hold all that the
orders and the Shapley values need.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.session import setting, settle, table

FILTERS = "ABCDE"
#: Least words; least percentage of distinct words; most percentage of capitals.
WORDS, DISTINCT, CAPITALS = 200, 50, 2
_SPACE = r"[\x20\x09-\x0D]+"
_MASKS = range(1 << len(FILTERS))
#: Stands for a missing doc_id, which comes after all others.
_LAST = (1 << 63) - 1


def word_counts(texts: DataFrame) -> DataFrame:
    """(d, h, total, uniq) of each document of texts (d, h, text), from its words; of rows that agree in d and h (they hold the same text) total is the sum."""
    words = texts.repartition("d", "h").select("d", "h", F.explode(F.split("text", _SPACE)).alias("word"))
    words = words.groupBy("d", "h", "word").agg(F.count("*").alias("n"))
    word = F.nullif("word", F.lit(""))
    return words.groupBy("d", "h").agg(F.sum(F.when(word.isNull(), 0).otherwise(F.col("n"))).alias("total"), F.count(word).alias("uniq"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of each row of docs (doc_id, text, source): bit k of mask is set if it fails the filter FILTERS[k]."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), text.alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    capitals = 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > CAPITALS * F.length("text")
    slim = rows.select("d", "h", "part", capitals.alias("c"), F.col("text").rlike("[#$%&*|]").alias("marks"), F.unhex(F.sha2("text", 256)).alias("same"))
    slim = settle(slim, "flags")
    # The first document of each text; a row that isn't one fails E. By both keys, so that no group of copies meets in one task.
    first = slim.groupBy("same").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("d")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    # Words of many documents meet one map of their own: another one before it, which is soon full, only costs.
    with setting(docs.sparkSession, "spark.sql.codegen.aggregate.map.twolevel.enabled", "false"):
        counted = settle(word_counts(rows.select("d", "h", "text")), "words")
    rows = slim.groupBy("d", "h").agg(F.count("*").alias("rows"))
    counted = counted.join(rows, ["d", "h"]).select("d", "h", F.expr("total div rows").alias("words"), "uniq")
    all_ = slim.join(counted, ["d", "h"], "left").join(first, ["d", "same"], "left").join(known, "d", "left")
    fails = [F.col("words") < WORDS, 100 * F.col("uniq") < DISTINCT * F.col("words"), F.col("c"), F.col("marks"), F.col("first").isNull()]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    no = F.lit(False)
    return all_.select(F.nullif("d", F.lit(_LAST)).alias("doc_id"), "part", mask.alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _total(counts: str, which: str, weight: str = "1") -> Column:
    """The sum of counts[m] over the masks m where which holds."""
    return F.expr(f"aggregate(sequence(0, {len(_MASKS) - 1}), 0L, (s, m) -> if({which}, s + {counts}[m] * ({weight}), s))")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each source, order and step.

    Filters: A under WORDS words, B less than DISTINCT % of them distinct, C more than CAPITALS % capitals, D a mark of
    `#$%&*|`, E the text of a smaller doc_id. A null text is an empty one, a null source an empty string; a row without
    a doc_id comes after all others and has no label; every row counts, repeated ones too (none is smaller than its
    like); of several labels of a doc_id any 1 decides. No rows, no parts. Other columns are ignored.
    """
    counts = failures(docs, labels).groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # For each part 32 conditional counts: of its rows by the set of filters that they fail, likewise of good and toxic ones.
    held = counts.groupBy("part").agg(*(F.expr(f"array({', '.join(f'coalesce(sum({c}) filter (where mask = {m}), 0)' for m in _MASKS)})").alias(c) for c in ("n", "good", "toxic")))
    orders = (f"named_struct('filter_order', '{''.join(o)}', 'bits', array({', '.join(str(1 << FILTERS.index(f)) for f in o)}))" for o in permutations(FILTERS))
    steps = held.select("*", F.explode(F.expr(f"array({', '.join(orders)})")).alias("o")).select("*", "o.filter_order", F.posexplode("o.bits").alias("at", "bit"))
    steps = steps.withColumn("before", F.expr("aggregate(slice(o.bits, 1, at), 0, (s, b) -> s | b)"))
    here = "(m & bit) <> 0 and (m & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        (F.col("at") + 1).cast("int").alias("step"),
        _total("n", "(m & (before | bit)) = 0").alias("kept"),
        _total("n", here).alias("removed"),
        _total("n", "(m & bit) <> 0 and (m & before) <> 0").alias("redundant"),
        _total("n", "m = bit").alias("unique_fails"),
        _total("good", here).alias("good_lost"),
        _total("toxic", here).alias("toxic_lost"),
        # Of 120 orders a row that fails k filters falls to this one in 120 / k.
        _total("n", "(m & bit) <> 0", "120 div bit_count(m)").alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT w.doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM w LEFT JOIN labels l USING (doc_id)),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS m FROM f),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[1:k - 1]), 0) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
p AS (SELECT DISTINCT part FROM m),
n AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
r AS (SELECT part, filter_order, step, bit, CAST(sum(n) FILTER ((m & (before | bit)) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER ((m & bit) <> 0 AND (m & before) = 0) AS BIGINT) AS removed,
    CAST(sum(n) FILTER ((m & bit) <> 0 AND (m & before) <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (m = bit) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER ((m & bit) <> 0 AND (m & before) = 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER ((m & bit) <> 0 AND (m & before) = 0) AS BIGINT) AS toxic_lost
  FROM p JOIN n USING (part), s GROUP BY ALL),
v AS (SELECT part, bit, sum(removed) AS shapley FROM r GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM r JOIN v USING (part, bit)
"""
