"""Runs of an archive compared by version, commit, capture, group or a label: where a metric changes, and pairs of places."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.functions import inference as I
from weir.sources.prometheus import version_key

CHANGES = "metric string, cell string, before string, after string, mean_before double, mean_after double, delta double, strength string"


def changes(cells: DataFrame, alpha: float = 0.05, effect: float = 0.147, seed: int = 0) -> DataFrame:
    """(metric, cell, before, after, mean_before, mean_after, delta, strength) of each place of a cell's axis where its values change.

    Places are in the order of versions; up to seven all their orders are tried, so that the test is exact. A group is a
    cell of a metric: a value a run and version. Values that are null or not finite are left out.
    """

    def each(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        at = sorted(g["axis"].unique(), key=version_key)
        levels = [sorted(g.loc[g["axis"] == a, "value"]) for a in at]
        cuts = I.trajectory(levels, alpha, effect, seed=I.fnv1a(seed, *key))
        out = []
        for lo, cut, hi in zip([0, *cuts], cuts, [*cuts[1:], len(at)]):
            old, new = sum(levels[lo:cut], []), sum(levels[cut:hi], [])
            delta, strength = I.cliffs_delta(new, old)
            out.append((*key, at[cut - 1], at[cut], sum(old) / len(old), sum(new) / len(new), delta, strength))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    known = cells.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    return known.groupBy("metric", "cell").applyInPandas(each, CHANGES)


def digest(cells: DataFrame) -> DataFrame:
    """(metric, axis, cells, runs, mean, least, most) of each metric and place."""
    return cells.groupBy("metric", "axis").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("runs"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
