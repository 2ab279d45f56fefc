"""Places of values within populations, none of which has to fit into a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .stats import num


def placed(rows: DataFrame, names: list[str], *groups: str) -> DataFrame:
    """``rows`` gain ``at_<name>`` (below, ties, total) for each of the columns: how many rows of the group have a lesser
    value, how many the same, and how many any; below and ties are NULL where the value is.

    Equal values are counted first, so ties cost nothing.  The different values are dealt by range; what stands before a
    range is a sum over ranges, and only within a range are values put in order.
    """
    rows = cut(rows)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_which"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(names)])).alias("x")
    keys = [*groups, "_which"]
    counted = rows.select(*groups, each).select(*groups, "x.*").where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_ties"))
    counted = cut(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    ranges = counted.groupBy(*keys, "_part").agg(F.sum("_ties").alias("n"), F.min("_v").alias("first"))  # as many as partitions
    whole = Window.partitionBy(*keys)
    starts = ranges.select(*keys, "_part", F.coalesce(F.sum("n").over(whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    index = counted.withColumn("inner", F.coalesce(F.sum("_ties").over(inner), F.lit(0))).join(F.broadcast(starts), [*keys, "_part"])
    index = index.select(*keys, "_v", (F.col("start") + F.col("inner")).alias("_below"), "_ties")
    totals = ranges.groupBy(*keys).agg(F.sum("n").alias("_total"))
    for i, c in enumerate(names):
        renamed = lambda df: df.where(F.col("_which") == i).drop("_which").withColumnsRenamed({g: f"_{g}" for g in groups})  # noqa: B023, E731
        same = [F.col(g) == F.col(f"_{g}") for g in groups]
        own, all_ = renamed(index), renamed(totals)
        rows = rows.join(own, reduce(Column.__and__, [*same, F.col(c).cast("double") == F.col("_v")]), "left").drop("_v", *[f"_{g}" for g in groups])
        # one row a group
        rows = rows.join(F.broadcast(all_), reduce(Column.__and__, same, F.lit(True)), "left").drop(*[f"_{g}" for g in groups])
        rows = rows.withColumn(f"at_{c}", F.struct(F.col("_below").alias("below"), F.col("_ties").alias("ties"), F.coalesce("_total", F.lit(0)).alias("total"))).drop("_below", "_ties", "_total")
    return rows


def midranks(rows: DataFrame, names: list[str], *groups: str) -> DataFrame:
    """``rows`` gain ``p_<name>``, the mid-rank percentile in (0, 1) within the group: ties share the average rank, and a NULL
    neither has one nor counts."""
    out = placed(rows, names, *groups)
    for c in names:
        x = F.col(f"at_{c}")
        rank = (x["below"] + 1).cast("double")
        out = out.withColumn(f"p_{c}", (rank + (x["ties"].cast("double") - num(1)) / num(2) - num(0.5)) / x["total"].cast("double")).drop(f"at_{c}")
    return out
