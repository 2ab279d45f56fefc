"""Usage of cards and archetypes within runs: counts, records, modes, concentration, trend.

Unknown is not zero: a sum over no known value stays NULL, and each rate has the denominator that it is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import num, rate
from .cohort import Cohort

PERIODS, LONGEST_PERIOD, PLAYSET, CORE_SHARE = 12, 30, 4, 0.5


def record() -> list[Column]:
    """Sums over the decks of which wins, losses and draws are all known."""
    known = F.col("wins").isNotNull() & F.col("losses").isNotNull() & F.col("draws").isNotNull()
    out = [F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("wins", "losses", "draws")]
    return [F.count(F.when(known, 1)).alias("record_decks"), *out]


def cut() -> list[Column]:
    """Decks of which the cut is known, and those that made it: NULL, not zero, if none is known."""
    return [F.count("made_cut").alias("cut_known"), F.sum(F.col("made_cut").cast("int")).alias("cut_made")]


def games() -> Column:
    return F.col("wins") + F.col("losses") + F.col("draws")


def win_rate(players: Column) -> Column:
    """Draws are shared by the players of a game; NULL without games."""
    return (F.col("wins").cast("double") + F.col("draws").cast("double") / players.cast("double")) / F.nullif(games().cast("double"), num(0))


def period_index() -> Column:
    """Which of the last ``PERIODS`` periods before the window's end the day is in; NULL outside them."""
    window = F.datediff("ends_before", "starts_on")
    period = F.least(F.lit(LONGEST_PERIOD), F.ceil(window / F.lit(PERIODS))).cast("int")
    index = F.lit(PERIODS - 1) - F.floor((F.datediff("ends_before", "occurred_on") - 1) / period)
    return F.when(index.between(0, PERIODS - 1), index.cast("int"))


def results(cohort: Cohort) -> DataFrame:
    """Decks with what is known of their standing."""
    own = cohort.standings.select("deck_id", "wins", "losses", "draws", "made_cut")
    return cohort.decks.join(own, "deck_id", "left")


def lines(cohort: Cohort, deck_cards: DataFrame) -> DataFrame:
    """One row for each card of each deck: the fact table of what follows."""
    return results(cohort).join(deck_cards, "deck_id")


def early_late() -> list[Column]:
    """Decks in the first and in the second half of the periods."""
    at = period_index()
    return [F.count(F.when(at < PERIODS // 2, 1)).alias("early"), F.count(F.when(at >= PERIODS // 2, 1)).alias("late")]


def card_usage(facts: DataFrame, *more: Column) -> DataFrame:
    """Per run and card the counts, the cut and the record, and whatever else is to be aggregated with them."""
    return facts.groupBy("format", "card_id").agg(
        *more,
        F.count("*").alias("deck_count"), F.countDistinct("event_id").alias("event_count"), F.sum("copies").cast("long").alias("copies"), F.count(F.when(F.col("copies") >= PLAYSET, 1)).alias("playsets"), *cut(), *record(), F.max("players_per_game").alias("players_per_game")
    )


def field(cohort: Cohort, *more: Column) -> DataFrame:
    """One row a run: the same over all decks."""
    return results(cohort).groupBy("format").agg(*more, F.count("*").alias("deck_count"), F.count("label").alias("labelled"), *cut(), *record(), F.max("players_per_game").alias("players_per_game"))


def counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("decks"))


def top_labels(facts: DataFrame, most: int = 3) -> DataFrame:
    """Per run and card the labels of most decks, ties in alphabetical order, and the number of labels."""
    labels = counted(facts.where(F.col("label").isNotNull()), "format", "card_id", "label")
    group = Window.partitionBy("format", "card_id")
    ranked = labels.withColumns({"place": F.row_number().over(group.orderBy(F.desc("decks"), "label")), "labels": F.count("*").over(group)})
    return ranked.where(F.col("place") <= most)


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key, the alphabetically first on ties."""
    each = counted(rows.where(F.col(value).isNotNull()), *keys, value)
    return each.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("decks")).alias("n"), F.col(value).alias("v"))).alias(value))


def concentration(rows: DataFrame, *keys: str) -> DataFrame:
    """Chance that two labelled decks share a label (unbiased); NULL with fewer than two."""
    each = counted(rows.where(F.col("label").isNotNull()), *keys, "label")
    n = F.sum("decks")
    pairs = F.sum(F.col("decks") * (F.col("decks") - 1))
    return each.groupBy(*keys).agg(n.alias("labelled"), rate(pairs, n * (n - 1)).alias("concentration"))


def label_profile(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the labelled decks, their concentration, and the commonest label with its decks: one exchange
    for all of these."""
    each = counted(rows.where(F.col("label").isNotNull()), *keys, "label")
    n, pairs = F.sum("decks"), F.sum(F.col("decks") * (F.col("decks") - 1))
    home = F.min_by("label", F.struct((-F.col("decks")).alias("n"), F.col("label").alias("l")))
    return each.groupBy(*keys).agg(n.alias("labelled"), rate(pairs, n * (n - 1)).alias("concentration"), home.alias("home"), F.max("decks").alias("home_support"))


def series(rows: DataFrame, *keys: str) -> DataFrame:
    """Long form: decks in each period that has any."""
    return counted(rows.withColumn("period", period_index()).where(F.col("period").isNotNull()), *keys, "period")


def archetypes(cohort: Cohort) -> DataFrame:
    """Per run and label: decks, cut, record."""
    return results(cohort).where(F.col("label").isNotNull()).groupBy("format", "label").agg(F.count("*").alias("deck_count"), *cut(), *record())


def cores(facts: DataFrame, share: float = CORE_SHARE) -> DataFrame:
    """Cards in at least ``share`` of an archetype's decks."""
    labelled = facts.where(F.col("label").isNotNull())
    sizes = labelled.groupBy("format", "label").agg(F.countDistinct("deck_id").alias("archetype_decks"))
    each = counted(labelled, "format", "label", "card_id")
    return each.join(sizes, ["format", "label"]).where(F.col("decks").cast("double") >= num(share) * F.col("archetype_decks").cast("double"))


def commander_names(decks: DataFrame, commanders: DataFrame, cards: DataFrame) -> DataFrame:
    """Decks named by their label, else by their commanders' names in order, joined by `` + ``."""
    named = commanders.join(cards.select("card_id", "name"), "card_id").groupBy("deck_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " + ").alias("commander_label"))
    return decks.join(named, "deck_id", "left").withColumn("archetype", F.coalesce("label", "commander_label"))


def spelled_commanders(decks: DataFrame, commanders: DataFrame, lines: DataFrame) -> DataFrame:
    """Decks with ``archetype``: their label, else their commanders' names in order, joined by `` + ``, each as the run's decks
    most often spell it, so that a card under two names is one archetype.  ``lines`` are (deck_id, card_id, name)."""
    unlabelled = decks.where(F.col("label").isNull()).select("deck_id", "format")
    leading = commanders.join(unlabelled, "deck_id").select("format", "deck_id", "card_id")
    asked = leading.select("format", "card_id").distinct()
    seen = lines.join(decks.select("deck_id", "format"), "deck_id").join(asked, ["format", "card_id"], "left_semi")
    names = mode(seen, ["format", "card_id"], "name")
    named = leading.join(names, ["format", "card_id"]).groupBy("deck_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " + ").alias("led_by"))
    return decks.join(named, "deck_id", "left").withColumn("archetype", F.coalesce("label", "led_by")).drop("led_by")


def published_order(cohort: Cohort, only: DataFrame | None = None) -> DataFrame:
    """Decks of each run numbered from 0: newest event first, then event, then source order.  Decks are numbered
    within their event, and an event's first number is the sum of the events before it, so no task sees a run.  With
    ``only`` (deck_id) just these decks are numbered, from the decks of their events."""
    sizes = cohort.decks.groupBy("format", "event_id", "occurred_on").agg(F.count("*").alias("n"))
    before = Window.partitionBy("format").orderBy(F.desc("occurred_on"), "event_id").rowsBetween(Window.unboundedPreceding, -1)  # events
    starts = sizes.select("format", "event_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    decks = cohort.decks
    if only is not None:
        decks = decks.join(decks.join(only, "deck_id", "left_semi").select("event_id").distinct(), "event_id", "left_semi")
    placed = decks.withColumn("inner", F.row_number().over(Window.partitionBy("event_id").orderBy("source_ord")))
    if only is not None:
        placed = placed.join(only, "deck_id", "left_semi")
    return placed.join(starts, ["format", "event_id"]).withColumn("position", F.col("start") + F.col("inner") - 1).drop("start", "inner")


def deck_headers(cohort: Cohort) -> DataFrame:
    """What a published deck shows of itself: its event, label and cut, and its record if all of it is known."""
    known = F.col("wins").isNotNull() & F.col("losses").isNotNull() & F.col("draws").isNotNull()
    return results(cohort).select("format", "deck_id", "event_id", "occurred_on", "label", "made_cut", *[F.when(known, F.col(c)).alias(c) for c in ("wins", "losses", "draws")])


def mainboards(deck_cards: DataFrame) -> DataFrame:
    """Each deck's cards in order (a deck is bounded)."""
    return deck_cards.groupBy("deck_id").agg(F.array_sort(F.collect_list("card_id")).alias("cards"))


def cooccurrence(facts: DataFrame, least: int = 2) -> DataFrame:
    """Extension: pairs of cards in one deck, with lift.  Pairs are made within a deck, which is bounded."""
    own = facts.select("format", "deck_id", "card_id")
    decks = own.groupBy("format").agg(F.countDistinct("deck_id").alias("n"))
    each = own.groupBy("format", "card_id").agg(F.count("*").alias("c"))
    hand = own.groupBy("format", "deck_id").agg(F.array_sort(F.collect_set("card_id")).alias("hand"))
    pairs = hand.select("format", F.explode("hand").alias("a"), "hand").select("format", "a", F.explode(F.filter("hand", lambda x: x > F.col("a"))).alias("b")).groupBy("format", "a", "b").agg(F.count("*").alias("together"))
    left, right = each.select("format", F.col("card_id").alias("a"), F.col("c").alias("ca")), each.select("format", F.col("card_id").alias("b"), F.col("c").alias("cb"))
    lift = F.col("together").cast("double") * F.col("n").cast("double") / (F.col("ca") * F.col("cb")).cast("double")
    return pairs.where(F.col("together") >= least).join(left, ["format", "a"]).join(right, ["format", "b"]).join(decks, "format").select("format", "a", "b", "together", lift.alias("lift"))


def share_series(rows: DataFrame, *keys: str) -> DataFrame:
    """Share of the run's decks in each of the periods, all of them present: zero decks are a share of zero,
    periods without any deck of the run a gap (NULL)."""
    totals = series(rows.select("format", "deck_id", "occurred_on", "starts_on", "ends_before").distinct(), "format").withColumnRenamed("decks", "total")
    every = rows.select("format", *keys).distinct().withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1))))
    full = every.join(series(rows, "format", *keys), ["format", *keys, "period"], "left").join(totals, ["format", "period"], "left")
    return full.select("format", *keys, F.col("period").cast("long").alias("period"), F.when(F.col("total").isNotNull(), rate(F.coalesce("decks", F.lit(0)), F.col("total"))).alias("share"))


def playoff_preview(placings: DataFrame, deck_cards: DataFrame, prior: float = 10.0, most: int = 10) -> DataFrame:
    """(deck_id, wins, losses) of playoff decks: cards by presence, with their record pulled toward one half."""
    n, w = F.sum(F.col("wins") + F.col("losses")).cast("double"), F.sum("wins").cast("double")
    each = placings.join(deck_cards, "deck_id").groupBy("card_id").agg(F.count("*").alias("decks"), ((w + num(prior) * num(0.5)) / (n + num(prior))).alias("record"))
    return each.orderBy(F.desc("decks"), F.desc("record"), "card_id").limit(most)
