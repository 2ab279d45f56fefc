"""Extension: values as they stood on a day, and chains of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Days of a bin.
BIN_DAYS = 30


def as_of(asked: DataFrame, told: DataFrame, key: str, day: str, value: str, bin_days: int = BIN_DAYS) -> DataFrame:
    """The rows of ``asked`` (key, day) with ``value`` and ``since``: the last value told (key, day, value) on or before their
    day, or NULL; of several told on one day the least.

    Time is cut into bins.  A key's bin holds its values of these days (one a day); of the bins before one that is asked only
    the last value is carried there.  So each row asked meets one row of its own bin and one of those before, in joins on
    key and bin: a key with very many rows is spread over its bins, and within one of them adaptive execution may split it.
    """
    names = asked.columns
    bin_of = F.floor(F.unix_date(day) / bin_days)
    asks = cut(asked.withColumn("bin", bin_of))
    known = told.where(F.col(key).isNotNull() & F.col(day).isNotNull() & F.col(value).isNotNull()).select(key, day, F.col(value).alias("v"))
    # values move once: both aggregates keep to key and bin
    daily = known.withColumn("bin", bin_of).repartition(key, "bin").groupBy(key, "bin", day).agg(F.min("v").alias("v"))
    held = daily.groupBy(key, "bin").agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), "v"))).alias("values"))
    last = held.select(key, "bin", F.element_at("values", -1).alias("last"))
    wanted = asks.select(key, "bin").where("bin IS NOT NULL").distinct()
    bins = last.withColumn("wanted", F.lit(False)).unionByName(wanted.withColumn("wanted", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy(key).orderBy("bin").rangeBetween(Window.unboundedPreceding, -1)  # bins of a key
    carried = bins.withColumn("before", F.last("last", ignorenulls=True).over(earlier)).where("wanted").select(key, "bin", "before")
    joined = asks.join(carried, [key, "bin"], "left").join(held, [key, "bin"], "left")
    here = F.try_element_at(F.filter("values", lambda v: v["day"] <= F.col(day)), F.lit(-1))
    best = F.coalesce(here, F.col("before"))
    return joined.withColumn("best", best).select(*names, F.col("best.v").alias(value), F.col("best.day").alias("since"))


def chain(previous: DataFrame) -> DataFrame:
    """(run_id, previous_id) to (run_id, earlier_id, steps): all earlier runs of each run along its chain."""
    return previous.sparkSession.sql(
        """WITH RECURSIVE walk AS (
             SELECT run_id, previous_id AS earlier_id, 1 AS steps FROM {previous} WHERE previous_id IS NOT NULL
             UNION ALL
             SELECT w.run_id, p.previous_id, w.steps + 1 FROM walk w JOIN {previous} p ON p.run_id = w.earlier_id WHERE p.previous_id IS NOT NULL)
           SELECT run_id, earlier_id, steps FROM walk""",
        previous=previous,
    )
