"""Checks whose result must be empty, and counts of what violates them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Where(NamedTuple):
    """Rows for which a condition must not hold.  All such checks of the same rows are counted in one pass."""

    rows: DataFrame
    condition: Column


Checks = Mapping[str, "DataFrame | Where"]


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def not_finite(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.isnan(column) | (F.abs(column) == float("inf")))


def not_descending(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value exceeds that of the row before in their group."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_before", before).where(F.col(value) > F.col("_before")).drop("_before")


def recount(claimed: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one of the two has."""
    names = claimed.columns
    return claimed.exceptAll(actual.select(names)).unionByName(actual.select(names).exceptAll(claimed))


def unlike(a: Column, b: Column) -> Column:
    """One of the two conditions holds without the other."""
    return a.eqNullSafe(b) == F.lit(False)


def incomplete(rows: DataFrame, scores: DataFrame, outputs: int) -> DataFrame:
    """Runs whose scores are not as many as their outputs times their scored cards."""
    cards = rows.groupBy("format").agg(F.count("*").alias("cards"))
    given = scores.groupBy("format").agg((F.count("*") * outputs).alias("given"))
    return cards.join(given, "format", "full").where(~(F.col("cards") * outputs).eqNullSafe(F.col("given")))


def score_run(rows: DataFrame, scores: DataFrame, outputs: int = 1) -> Checks:
    """What a run's cards (usage with win_rate, home, home_support and labelled) and scores must not hold."""
    games = F.col("wins") + F.col("losses") + F.col("draws")
    n, labelled, support = F.col("deck_count"), F.coalesce("labelled", F.lit(0)), F.coalesce("home_support", F.lit(0))
    key = ["format", "card_id"]
    return {
        "repeated card": repeated(rows, *key),
        "cut known": Where(rows, unlike(F.col("cut_made").isNull(), F.col("cut_known") == 0)),
        "label known": Where(rows, unlike(F.col("home").isNull(), labelled == 0)),
        "record or copies": Where(rows, (F.col("record_decks") > n) | (F.col("copies") < n)),
        "win rate known": Where(rows, unlike(F.col("win_rate").isNull(), games == 0)),
        "bounds": Where(rows, (F.col("event_count") > n) | (F.col("cut_known") > n) | (F.col("cut_made") > F.col("cut_known"))),
        "labelled decks": Where(rows, (support > labelled) | (labelled > n)),
        "unscored card": rows.join(scores.select(*key), key, "left_anti"),
        "unknown card": scores.join(rows.select(*key), key, "left_anti"),
        "repeated score": repeated(scores, *key),
        "not finite": not_finite(scores, "score"),
        "incomplete run": incomplete(rows, scores, outputs),
    }


def archetype_rules(archetypes: DataFrame) -> Checks:
    """What a run's archetypes (label, deck_count, event_count, cut, record, win_rate) must not hold."""
    games = F.col("wins") + F.col("losses") + F.col("draws")
    return {
        "repeated label": repeated(archetypes, "format", "label"),
        "label's cut known": Where(archetypes, unlike(F.col("cut_made").isNull(), F.col("cut_known") == 0)),
        "label's counts": Where(archetypes, F.greatest("record_decks", "event_count", "cut_known") > F.col("deck_count")),
        "label's win rate known": Where(archetypes, unlike(F.col("win_rate").isNull(), games == 0)),
    }


def leading_labels(cards: DataFrame, tops: DataFrame) -> Checks:
    """Of cards (home, home_support, labels: how many different ones) and their top labels in order (label, decks, place
    from 1): the first must be the card's own, and there are no more than different labels."""
    key = ["format", "card_id"]
    listed = tops.groupBy(*key).agg(F.count("*").alias("n"), F.min_by(F.struct("label", "decks"), "place").alias("first"))
    both = cards.join(listed, key, "left")
    differs = ~F.col("first.label").eqNullSafe(F.col("home")) | (F.coalesce("first.decks", F.lit(0)) != F.coalesce("home_support", F.lit(0)))
    return {"leading label": Where(both, differs | (F.coalesce("labels", F.lit(0)) < F.coalesce("n", F.lit(0))))}


def method_runs(runs: DataFrame, scores: DataFrame, cards: DataFrame, told: DataFrame) -> Checks:
    """What a run's methods must not hold.  ``runs`` (format, method, outputs: the names declared), ``scores`` in long form
    (format, method, card_id, output, value), ``cards`` (format, card_id) to be scored, ``told`` (format, scored_cards)."""
    key = ["format", "method", "card_id"]
    given = scores.groupBy(*key).agg(F.array_sort(F.collect_set("output")).alias("given"), F.count("*").alias("n"))
    declared = runs.select("format", "method", F.array_sort("outputs").alias("outputs"))
    asked = cards.select("format", "card_id").join(declared.select("format", "method"), "format")
    scored = given.join(declared, ["format", "method"], "left")
    counted = cards.groupBy("format").agg(F.count("*").alias("cards")).join(told, "format", "full")
    return {
        "repeated method": repeated(runs, "format", "method"),
        "unscored card of a method": asked.join(given, key, "left_anti"),
        "card without a method's run": given.join(asked, key, "left_anti"),
        "declared outputs": Where(scored, ~F.col("given").eqNullSafe(F.col("outputs"))),
        "output twice": Where(scored, F.col("n") > F.size("given")),
        "output not finite": Where(scores, F.isnan("value") | (F.abs("value") == float("inf"))),
        "scored cards": Where(counted, ~F.col("cards").eqNullSafe(F.col("scored_cards"))),
    }


def recounted(cards: DataFrame, decks: DataFrame) -> DataFrame:
    """What the decks that cards list by their position come to: (format, card_id) with deck_count, event_count, copies,
    cut and record.  ``cards`` have the parallel arrays ``positions`` and ``deck_copies``; a position without a deck counts
    as a deck of which nothing is known."""
    whole = cards.withColumn("deck_copies", F.coalesce("deck_copies", F.array().cast(cards.schema["deck_copies"].dataType)))  # decks are recounted without them
    lines = whole.select("format", "card_id", F.posexplode_outer(F.arrays_zip("positions", "deck_copies")).alias("ord", "line"))
    lines = lines.select("format", "card_id", F.col("line.positions").alias("position"), F.col("line.deck_copies").alias("copies"))
    seen = lines.join(decks.select("format", "position", "event_id", "made_cut", "wins", "losses", "draws"), ["format", "position"], "left")
    known = F.col("wins").isNotNull() & F.col("losses").isNotNull() & F.col("draws").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0)).cast("long").alias(c)
    return seen.groupBy("format", "card_id").agg(
        F.count("position").alias("deck_count"), F.countDistinct("event_id").alias("event_count"), F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("copies"), F.count("made_cut").alias("cut_known"),
        F.sum(F.col("made_cut").cast("long")).alias("cut_made"), F.count(F.when(known, 1)).alias("record_decks"), total("wins"), total("losses"), total("draws"),
    )


#: What a card claims of its decks, by the rule that a difference breaks.
CLAIMS = {"card's decks": ("deck_count",), "card's copies": ("copies",), "card's events": ("event_count",), "card's cuts": ("cut_known", "cut_made"), "card's record": ("record_decks", "wins", "losses", "draws")}


def published_decks(decks: DataFrame, cards: DataFrame, events: DataFrame, totals: DataFrame) -> Checks:
    """What a run's published decks must not hold, every count of a card being recounted from the decks that it lists.

    ``decks`` (format, position from 0, deck_id, event_id, made_cut, record, ``commanders``, ``sideboard``: arrays of cards,
    NULL if unstated), ``cards`` (format, card_id, what CLAIMS names, ``positions`` and ``deck_copies``, NULL if unlisted),
    ``events`` (format, event_id, occurred_on) and ``totals`` (format, decks).  Claims and recount meet in one aggregate by
    card, and all rules are counted on it at once; a card that differs, is listed twice or not at all counts where it does."""
    key = ["format", "card_id"]
    again = recounted(cards, decks)
    sizes = decks.groupBy("format").agg(F.count("*").alias("n"))
    dated = decks.join(events.select("format", "event_id", "occurred_on"), ["format", "event_id"], "left")
    p, c = F.col("positions"), F.col("deck_copies")
    pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: b <= a)
    listed = cards.join(sizes, "format", "left")
    lines = cards.select("format", "card_id", F.explode("positions").alias("position"))
    named = decks.select("format", "position", F.explode("commanders").alias("card_id")).distinct()
    checks: dict[str, DataFrame | Where] = {
        "decks' total": decks.groupBy("format").agg(F.count("*").alias("n")).join(totals, "format", "full").where(~F.col("n").eqNullSafe(F.col("decks"))),
        "repeated deck": repeated(decks, "format", "deck_id"),
        "event of a deck": Where(dated, F.col("occurred_on").isNull()),
        "newest first": later_than_before(dated),
        "unlisted decks": Where(listed, p.isNull() | c.isNull() | (F.size(p) != F.size(c))),
        "ascending decks": Where(listed, F.exists(pairs, lambda x: x) | (F.element_at(p, -1) >= F.coalesce("n", F.lit(0)))),
        "unplayed deck": decks.select("format", "position").join(lines, ["format", "position"], "left_anti"),
        "unstated lists": Where(decks, F.col("commanders").isNull() | F.col("sideboard").isNull()),
        "commander in the deck": named.join(lines, ["format", "position", "card_id"], "left_anti").select("format", "position").distinct(),
        "sideboard's card twice": Where(decks, F.size(F.array_distinct("sideboard")) != F.size("sideboard")),
    }
    claims = [name for names in CLAIMS.values() for name in names]
    sides = cards.select(*key, *claims, F.lit(True).alias("_told")).unionByName(again.select(*key, *claims, F.lit(False).alias("_told")))
    value = lambda told, names: F.min(F.when(F.col("_told") == told, F.struct(*names)))
    met = sides.groupBy(*key).agg(
        F.count_if("_told").alias("told"), F.count_if(~F.col("_told")).alias("found"),
        *[value(told, names).alias(f"{'told' if told else 'found'}{i}") for i, names in enumerate(CLAIMS.values()) for told in (True, False)],
    )
    for i, rule in enumerate(CLAIMS):
        checks[rule] = Where(met, (F.col("told") != 1) | (F.col("found") != 1) | ~F.col(f"told{i}").eqNullSafe(F.col(f"found{i}")))
    return checks


def later_than_before(dated: DataFrame) -> DataFrame:
    """Decks of a later day than the deck before them.  The deck before is found by its position, so no task needs a run's
    decks in order."""
    before = dated.select("format", (F.col("position") + 1).alias("position"), F.col("occurred_on").alias("day_before"))
    return dated.select("format", "position", "occurred_on").join(before, ["format", "position"]).where(F.col("occurred_on") > F.col("day_before"))


def overall_run(cards: DataFrame, graded: DataFrame, components: DataFrame, scores: DataFrame, own: str = "OVERALL") -> Checks:
    """The same of an overall run: its cards (pooled usage), the (card_id, format) that graded them, its components'
    formats, and its scores."""
    n = F.col("deck_count")
    return {
        "repeated component": repeated(components, "format"),
        "own component": Where(components, F.col("format") == own),
        "repeated card": repeated(cards, "card_id"),
        "cut known": Where(cards, unlike(F.col("cut_made").isNull(), F.col("cut_known") == 0)),
        "counts": Where(cards, (F.col("event_count") > n) | (F.col("cut_known") > n) | (F.col("copies") < n)),
        "no component": graded.join(components, "format", "left_anti"),
        "unscored card": cards.join(scores.select("card_id"), "card_id", "left_anti"),
        "unknown card": scores.join(cards.select("card_id"), "card_id", "left_anti"),
        "repeated score": repeated(scores, "card_id"),
        "not finite": not_finite(scores, "score"),
    }


def counts(checks: Checks) -> DataFrame:
    """(rule, violations) of every check; conditions on the same rows are one aggregate."""
    together: dict[int, dict[str, Where]] = {}
    parts = []
    for rule, check in checks.items():
        if isinstance(check, Where):
            together.setdefault(id(check.rows), {})[rule] = check
        else:
            parts.append(check.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations"))
    for rules in together.values():
        rows = next(iter(rules.values())).rows
        one = rows.agg(*[F.count_if(F.coalesce(x.condition, F.lit(False))).alias(f"n{i}") for i, x in enumerate(rules.values())])
        listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"n{i}").alias("violations")) for i, rule in enumerate(rules)])
        parts.append(one.select(F.explode(listed).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, parts)


def require(checks: Checks) -> None:
    """Raises with the rules that are violated."""
    if bad := {r["rule"]: r["violations"] for r in counts(checks).collect() if r["violations"]}:
        raise ValueError(f"violated: {bad}")
