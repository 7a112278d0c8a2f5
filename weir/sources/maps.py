"""Address maps: which module an instruction address of a process belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.operators.temporal import point_in_interval

_LINE = r"^([0-9a-f]+)-([0-9a-f]+) (\S{4}) ([0-9a-f]+) \S+ \d+\s*(.*)$"


def parse_maps(lines: DataFrame) -> DataFrame:
    """(pid, lo, hi, offset, module) of lines (pid, line) in the format of /proc/PID/maps; other lines are dropped."""
    g = [F.regexp_extract("line", _LINE, k) for k in range(1, 6)]
    hexed = lambda c: F.conv(c, 16, 10).try_cast("long")
    return lines.where(F.col("line").rlike(_LINE)).select("pid", hexed(g[0]).alias("lo"), hexed(g[1]).alias("hi"), hexed(g[3]).alias("offset"), g[4].alias("module"))


def resolve(addresses: DataFrame, maps: DataFrame, width: int = 1 << 24) -> DataFrame:
    """addresses (pid, ip, ...) with symbol, module+0xoffset, or the bare address where no map holds it."""
    keyed = addresses.withColumn("_id", F.struct("pid", "ip"))
    hit = point_in_interval(keyed.select("pid", "ip", "_id").distinct(), maps, ["pid"], "ip", "lo", "hi", width)
    name = F.concat(F.element_at(F.split("module", "/"), -1), F.lit("+0x"), F.lower(F.hex(F.col("ip") - F.col("lo") + F.col("offset"))))
    named = hit.groupBy("_id").agg(F.min(name).alias("symbol"))
    return keyed.join(named, "_id", "left").withColumn("symbol", F.coalesce("symbol", F.concat(F.lit("0x"), F.lower(F.hex("ip"))))).drop("_id")
