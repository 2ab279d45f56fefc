"""Extension: packages, sets of cards that decks of a run hold together."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.stats import rate

#: Items that may be broadcast to the sets that hold them; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def packages(lines: DataFrame, least: int, smallest: int = 2) -> DataFrame:
    """(format, deck_id, item) to (format, items in order, size, decks, lift): the sets of at least ``smallest`` items that
    at least ``least`` decks of a run hold.  ``lift`` is their decks over those that the items would share by chance.

    All runs are mined in one pass by parallel FP-growth: an item carries its run, so sets never mix runs; each group of
    items grows the trees of what stands before its own in the decks, and no task holds all decks.  ``least`` is a
    count, as runs differ in size, and the one minimum that bounds the number of sets.
    """
    # a deck's items in one row: mining, counts of items and sizes of runs are all read from it
    decks = cut(lines.where(F.col("item").isNotNull()).groupBy("format", "deck_id").agg(F.collect_set(F.col("item").cast("string")).alias("held")))
    key = lambda x: F.to_json(F.struct("format", x.alias("item")))
    # decks of fewer items than a set has are in none
    large = decks.where(F.size("held") >= smallest).select(F.transform("held", key).alias("items"))
    n = large.count()
    schema = "format string, items array<string>, size int, decks long, lift double"
    if not n:
        return lines.sparkSession.createDataFrame([], schema)
    # a hair below the share that the count is, so that rounding loses no set; the count itself is asked afterwards
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), numPartitions=int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))).fit(large)
    item = lambda x: F.from_json(x, "format string, item string")
    found = cut(model.freqItemsets.where((F.col("freq") >= least) & (F.size("items") >= smallest)).select(F.transform("items", item).alias("x"), F.col("freq").alias("decks")))
    sets = found.select(F.col("x")[0]["format"].alias("format"), F.array_sort(F.col("x.item")).alias("items"), "decks")
    sizes = decks.groupBy("format").agg(F.count("deck_id").alias("n"))
    # what a set holds is no rarer than the set
    counts = decks.select("format", F.explode("held").alias("item")).groupBy("format", "item").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    singles = cut(counts.join(sizes, "format"))
    if singles.count() <= BROADCAST_ROWS:
        singles = F.broadcast(singles)
    own = sets.select("format", "items", "decks", F.posexplode("items").alias("at", "item")).join(singles, ["format", "item"])
    # shares are multiplied in the order of the items, so that the product is the same wherever it is made
    shares = F.array_sort(F.collect_list(F.struct("at", rate(F.col("c"), F.col("n")).alias("share"))))
    each = own.groupBy("format", "items", "decks").agg(F.aggregate(shares, F.lit(1.0), lambda a, x: a * x["share"]).alias("chance"), F.max("n").alias("n"))
    return each.select("format", "items", F.size("items").alias("size"), "decks", (rate(F.col("decks"), F.col("n")) / F.col("chance")).alias("lift"))
