"""Extension: how archetypes do against each other, from single matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import num, rate

#: Standard normal quantile of a two-sided 95 % interval.
Z = 1.96
TURNED = {"won": "lost", "lost": "won", "drew": "drew"}


def once(pairings: DataFrame) -> DataFrame:
    """(event_id, round, seen, deck, opponent, result) to each pairing once, the lesser deck first: of several reports of one,
    the first seen counts, turned round where it is the other seat's."""
    turned = F.create_map(*[F.lit(x) for pair in TURNED.items() for x in pair])
    result = F.when(F.col("deck") < F.col("opponent"), F.col("result")).otherwise(F.try_element_at(turned, F.col("result")))
    rows = pairings.where(F.col("deck") != F.col("opponent")).select("event_id", "round", F.least("deck", "opponent").alias("a"), F.greatest("deck", "opponent").alias("b"), F.struct("seen", result.alias("result")).alias("x"))
    return rows.groupBy("event_id", "round", "a", "b").agg(F.min("x").alias("x")).select("event_id", "round", "a", "b", "x.result")


def interval(wins: Column, draws: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's interval of a win rate in which a draw is half a win."""
    n_ = n.cast("double")
    p, zz = (wins.cast("double") + draws.cast("double") * num(0.5)) / n_, num(Z * Z)
    middle, half = p + zz / (num(2.0) * n_), num(Z) * F.sqrt((p * (num(1.0) - p) + zz / (num(4.0) * n_)) / n_)
    return (middle - half) / (num(1.0) + zz / n_), (middle + half) / (num(1.0) + zz / n_)


def matrix(pairings: DataFrame, decks: DataFrame) -> DataFrame:
    """(format, label, against) with matches, wins, losses, draws, the win rate and its interval: every match from both
    seats, so the cell of two labels mirrors the other.  A label against itself has its
    matches once, as a win and a loss or a draw, and no rate.
    ``decks`` are (deck_id, format, label); matches of decks without a label, or of two formats, aren't counted.  Both joins
    are on deck ids; labels meet only in map-side aggregates, so a label of a third of all decks is no hot key."""
    of = lambda side, name: decks.where(F.col("label").isNotNull()).select(F.col("deck_id").alias(side), F.col("format").alias(f"format_{side}"), F.col("label").alias(name))
    met = once(pairings).join(of("a", "x"), "a").join(of("b", "y"), "b").where(F.col("format_a") == F.col("format_b"))
    turned = F.create_map(*[F.lit(v) for pair in TURNED.items() for v in pair])
    seats = F.array(F.struct(F.col("x").alias("label"), F.col("y").alias("against"), F.col("result").alias("r")), F.struct(F.col("y").alias("label"), F.col("x").alias("against"), F.try_element_at(turned, F.col("result")).alias("r")))
    each = met.select(F.col("format_a").alias("format"), F.explode(seats).alias("s")).groupBy("format", "s.label", "s.against").agg(
        F.count("*").alias("seats"), *[F.count(F.when(F.col("s.r") == r, 1)).alias(n) for r, n in (("won", "wins"), ("lost", "losses"), ("drew", "draws"))]
    )
    mirror = F.col("label") == F.col("against")
    halved = lambda c: F.when(mirror, F.floor(F.col(c) / 2)).otherwise(F.col(c)).cast("long")
    # of a mirror match both seats are here: two seats, one win and one loss, or two draws
    cells = each.select("format", "label", "against", halved("seats").alias("matches"), "wins", "losses", halved("draws").alias("draws"))
    n = F.col("matches")
    low, high = interval(F.col("wins"), F.col("draws"), n)
    own = F.when(F.col("label") != F.col("against"), rate(F.col("wins") * 2 + F.col("draws"), n * 2))
    return cells.withColumns({"win_rate": own, "low": F.when(own.isNotNull(), low), "high": F.when(own.isNotNull(), high)})


def pivoted(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A row a label and a column for each of ``labels``: the win rate against it."""
    return cells.groupBy("format", "label").pivot("against", list(labels)).agg(F.first("win_rate"))
