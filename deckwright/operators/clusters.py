"""Extension: groups of decks that have no label, by the cards that they hold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Decks of a run that medoids are chosen from.
SAMPLE_DECKS = 300


def vectors(lines: DataFrame) -> DataFrame:
    """(format, deck_id, card_id, copies) to (format, deck_id, card_id, weight): copies, damped, times how rare the card is in
    its run; a deck's weights have length 1.  Cards that every deck holds weigh nothing, and go."""
    decks = lines.groupBy("format").agg(F.countDistinct("deck_id").alias("n"))
    held = lines.groupBy("format", "card_id").agg(F.countDistinct("deck_id").alias("df"))
    rare = held.join(decks, "format").select("format", "card_id", F.log(F.col("n") / F.col("df")).alias("idf"))
    raw = lines.join(rare, ["format", "card_id"]).select("format", "deck_id", "card_id", (F.log1p("copies") * F.col("idf")).alias("w")).where("w > 0")
    length = raw.groupBy("format", "deck_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(length, ["format", "deck_id"]).select("format", "deck_id", "card_id", (F.col("w") / F.col("length")).alias("weight"))


def medoids(weights: DataFrame, k: int, sample: int = SAMPLE_DECKS) -> DataFrame:
    """(format, medoid, cluster from 0): at most ``k`` decks of each run, each the member of its group with the least
    distance to the others, from a bounded sample that the decks' hashes choose.  The first centers are those farthest
    from each other; groups and their medoids are then settled in turns.  Ties go to the lesser deck."""
    decks = weights.select("format", "deck_id").distinct()
    order = F.row_number().over(Window.partitionBy("format").orderBy(F.xxhash64("deck_id"), "deck_id"))  # limited before the shuffle, too
    chosen = decks.withColumn("n", order).where(F.col("n") <= sample).drop("n")
    rows = weights.join(F.broadcast(chosen), ["format", "deck_id"], "left_semi")  # at most ``sample`` a run

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(frame["deck_id"].to_numpy())
        cards, column = np.unique(frame["card_id"].to_numpy(), return_inverse=True)
        x = np.zeros((len(ids), len(cards)))
        x[np.searchsorted(ids, frame["deck_id"].to_numpy()), column] = frame["weight"].to_numpy()
        away = np.round(1 - x @ x.T, 9)
        centers = [int(away.sum(1).argmin())]
        while len(centers) < min(k, len(ids)) and away[:, centers].min(1).max() > 0:
            centers.append(int(away[:, centers].min(1).argmax()))
        for _ in range(20):
            group = away[:, centers].argmin(1)
            new = [int(own[away[np.ix_(own, own)].sum(1).argmin()]) if len(own := np.flatnonzero(group == c)) else centers[c] for c in range(len(centers))]
            if new == centers:
                break
            centers = new
        return pd.DataFrame({"format": frame["format"].iloc[0], "medoid": ids[sorted(centers)], "cluster": np.arange(len(centers))})

    return rows.groupBy("format").applyInPandas(choose, "format string, medoid long, cluster int")


def assign(weights: DataFrame, centers: DataFrame) -> DataFrame:
    """(format, deck_id, cluster, distance) of every deck: the medoid that it shares most with, the lesser cluster on ties, or
    NULL and 1 if it shares nothing with any.  Decks meet medoids on the cards that both hold."""
    own = centers.join(weights.withColumnRenamed("deck_id", "medoid").withColumnRenamed("weight", "theirs"), ["format", "medoid"]).select("format", "cluster", "card_id", "theirs")
    near = weights.join(own, ["format", "card_id"]).groupBy("format", "deck_id", "cluster").agg(F.round(F.sum(F.col("weight") * F.col("theirs")), 9).alias("alike"))
    best = near.groupBy("format", "deck_id").agg(F.max(F.struct("alike", (-F.col("cluster")).alias("c"))).alias("b"))
    decks = weights.select("format", "deck_id").distinct()
    return decks.join(best, ["format", "deck_id"], "left").select("format", "deck_id", (-F.col("b.c")).alias("cluster"), (F.lit(1.0) - F.coalesce("b.alike", F.lit(0.0))).alias("distance"))


def clustered(lines: DataFrame, k: int, sample: int = SAMPLE_DECKS) -> tuple[DataFrame, DataFrame]:
    """The assignment of every deck, and the objective: (format, clusters, decks, mean distance, mean distance to the one
    medoid of all), which tells what the groups are worth."""
    weights = cut(vectors(lines))
    found = cut(assign(weights, cut(medoids(weights, k, sample))))
    single = assign(weights, cut(medoids(weights, 1, sample)))
    one = single.groupBy("format").agg(F.avg("distance").alias("single"))
    each = found.groupBy("format").agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("decks"), F.avg("distance").alias("distance"))
    return found, each.join(one, "format")
