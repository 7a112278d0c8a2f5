"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Texts are counted into cells of source, language and topic (aggregated before the shuffle, so a source that holds
a third of all rows is one row a task). Fitting rescales the cells' token weights to each marginal in turn, by
windows over the table of cells, until they agree with all three. A cell's probability is its weight against its
tokens times a factor that makes the expected tokens meet the budget although no probability exceeds 1; a row is
drawn by a hash of its doc_id. Built-in functions throughout; only single numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weir.session import settle, table

#: Topics by the first of these that a text holds: words in any case, else a pattern (with a string that each of its matches holds, which is cheaper to find).
TOPICS = (("license", ("licensed", "licenced", "copyright"), None), ("contact", ("@",), "[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][A-Za-z]"), ("table", (" | ",), None), ("numbers", (), "[0-9]{4}"))
DIMS = ("source", "lang", "topic")
#: A target marginal is the token share to this power, rescaled; explicit shares can replace it.
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Share of tokens drawn; fits of all dimensions at most, and before the cells are written; greatest gap that ends fitting.
BUDGET, ROUNDS, SWEEPS, CLOSE = 0.5, 32, 4, 1e-6


def topic() -> Column:
    t = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(t)
    out = F.when(F.length(F.trim(t)) == 0, "empty")
    for name, words, pattern in TOPICS:
        hit = F.lit(not words)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = out.when(hit if pattern is None else hit & t.rlike(pattern), name)
    return out.otherwise("prose")


def named(value: str | None) -> str:
    """The name of a source or language in the table of cells: null is a value of its own, apart from every string."""
    return "" if value is None else f"={value}"


def tokens() -> Column:
    """About four bytes a token, one at least."""
    return F.greatest(F.ceil(F.octet_length(F.coalesce(F.col("text"), F.lit(""))) / 4), F.lit(1)).cast("long")


def _described(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the columns, as a struct) beside id, source, lang (see named), topic and tokens."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row")
    name = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("source", "lang")]
    return docs.select(row, F.col("doc_id").cast("long").alias("id"), *name, topic().alias("topic"), tokens().alias("tokens"))


def fit_cells(described: DataFrame, budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source, lang, topic, n, tokens, weight, p) of each cell: fitted share of tokens, probability of its rows.

    source and lang are written as by named. targets: shares by dimension and value (None for null); values that it leaves out get none. A dimension without targets gets
    the token shares to its POWER. Where targets contradict each other or an empty cell, fitting stops after ROUNDS.
    """
    spark = described.sparkSession
    cells = described.groupBy(*DIMS).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    cells = settle(cells, "cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0)).withColumn("p", F.lit(0.0))
    for d in DIMS:
        if targets and d in targets:
            pairs = [x for v, s in targets[d].items() for x in (F.lit(v if d == "topic" else named(v)), F.lit(float(s) / sum(targets[d].values())))]
            cells = cells.withColumn(f"want_{d}", F.coalesce(F.create_map(*pairs)[F.col(d)], F.lit(0.0)))
        else:
            margin = cells.groupBy(d).agg((F.sum("tokens") / total).alias("share")).withColumn("power", F.pow("share", F.lit(POWER[d])))
            scale = margin.agg(F.sum("power")).first()[0]
            cells = cells.join(margin.select(d, (F.col("power") / scale).alias(f"want_{d}")), d)
    cells = settle(cells.withColumn("weight", F.col("tokens") / total), "wanted")
    for _ in range(0, ROUNDS, SWEEPS):
        for _ in range(SWEEPS):
            for d in DIMS:
                got = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(got > 0, F.col("weight") * F.col(f"want_{d}") / got).otherwise(0.0))
        # The gap of the dimensions fitted before the last one goes with the cells.
        gaps = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"want_{d}")) for d in DIMS[:-1]]
        cells = settle(cells.withColumn("gap", F.greatest(*gaps)), "raked")
        off = cells.agg(F.max("gap")).first()[0]
        cells = cells.drop("gap")
        if off < CLOSE:
            break
    rate = F.col("weight") / F.col("tokens")
    factor = budget * total
    for _ in range(ROUNDS):  # rows of scarce cells are all taken; the others make up for it
        full = rate * factor >= 1
        held, open_ = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_ or held >= budget * total:
            break
        new = (budget * total - held) / open_
        if abs(new - factor) <= 1e-12 * factor:
            break
        factor = new
    return cells.select(*DIMS, "n", "tokens", "weight", F.round(F.least(rate * factor, F.lit(1.0)), 9).alias("p"))


def _draw(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


def mix(docs: DataFrame, columns: list[str], budget: float = BUDGET, targets: dict[str, dict[str, float]] | None = None, seed: int = 7) -> DataFrame:
    """row (columns as a struct), topic, tokens, p and weight (1 / p) of the rows of docs (doc_id, text, lang, source) that are drawn.

    A null source or language is a value of its own; a null text is empty (one token, topic "empty"); rows of one
    doc_id (a null one among them) and cell are drawn or left together. An empty table gives an empty result.
    """
    described = _described(docs, columns)
    cells = settle(fit_cells(described.drop("row"), budget, targets).select(*DIMS, "p"), "probabilities")
    # No hint: Spark broadcasts the cells if their size allows, else AQE splits a hot source.
    drawn = described.join(cells, list(DIMS)).where(_draw(seed) < F.col("p"))
    return drawn.select("row", "topic", "tokens", "p", (1 / F.col("p")).alias("weight"))


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"])
    return out.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", F.round("p", 6).alias("p"), F.round("weight", 6).alias("weight"))
