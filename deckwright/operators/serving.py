"""Ranked pages over score tables: ranks come before filters, unknown scores sort last in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.places import placed

#: Columns that a page can be sorted by.
SORTS = {"ranking", "score", "deck_count", "win_rate", "name"}


def ranked(scores: DataFrame) -> DataFrame:
    """Every card of a run with its rank; cards without a score share the last."""
    at = F.col("at_score")
    above = F.coalesce(at["total"] - at["below"] - at["ties"], at["total"])
    return placed(scores, ["score"], "format").withColumn("ranking", above + 1).drop("at_score")


def movement(now: DataFrame, before: DataFrame) -> DataFrame:
    """Ranked rows with the previous rank and the places gained."""
    old = before.select("format", "card_id", F.col("ranking").alias("previous"))
    return now.join(old, ["format", "card_id"], "left").withColumn("moved", F.col("previous") - F.col("ranking"))


def view_counts(moved: DataFrame) -> DataFrame:
    """Per run: all cards, risers and fallers."""
    return moved.groupBy("format").agg(F.count("*").alias("everything"), F.count(F.when(F.col("previous") > F.col("ranking"), 1)).alias("risers"), F.count(F.when(F.col("previous") < F.col("ranking"), 1)).alias("fallers"))


def color_filter(colors: Column, chosen: Sequence[str]) -> Column:
    """Any overlap; ``C`` asks for known colourlessness.  Unknown colours match nothing."""
    some = [c for c in chosen if c != "C"]
    match = F.arrays_overlap(colors, F.array(*map(F.lit, some))) if some else F.lit(False)
    return F.coalesce(match | (F.size(colors) == 0) if "C" in chosen else match, F.lit(False)) & colors.isNotNull()


def identity_within(colors: Column, chosen: Sequence[str]) -> Column:
    return colors.isNotNull() & (F.size(F.array_except(colors, F.array(*map(F.lit, chosen)).cast("array<string>"))) == 0)


def page(rows: DataFrame, sort: str = "ranking", descending: bool = False, limit: int = 25, offset: int = 0, tie: Sequence[str] = ("format", "card_id")) -> DataFrame:
    """A page in an order of a closed set, NULLs last, ties by the key."""
    if sort not in SORTS or not 1 <= limit <= 200 or offset < 0:
        raise ValueError("no such page")
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return rows.orderBy(first, *tie).offset(offset).limit(limit)


def compare(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Cards across runs: how many rank them, their best score and the run of it (first in order on ties)."""
    own = ranked(rows).where(F.col("score").isNotNull())
    best = F.min_by("format", F.struct((-F.col("score")).alias("s"), F.col("format").alias("f")))
    each = own.groupBy("card_id").agg(F.count("*").alias("formats"), best.alias("best_format"), F.max("score").alias("best"), F.min("ranking").alias("best_ranking"))
    return each.join(names, "card_id")


def latest(runs: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def by_run(rows: DataFrame) -> DataFrame:
    """(card_id, runs): each card's score and rank by run, as one map."""
    return rows.groupBy("card_id").agg(F.map_from_entries(F.collect_list(F.struct("format", F.struct("score", "ranking")))).alias("runs"))


def compare_page(rows: DataFrame, run: str, limit: int, names: DataFrame) -> DataFrame:
    """The first cards by their score in the chosen run, those without one last; names are looked up for the page
    only."""
    chosen = F.try_element_at("runs", F.lit(run))["score"]
    page_rows = by_run(rows).withColumn("chosen", chosen).orderBy(F.desc_nulls_last("chosen"), "card_id").limit(limit)
    return F.broadcast(page_rows).join(names, "card_id")  # at most ``limit`` rows


def previous_run(runs: DataFrame) -> DataFrame:
    """(run_id, previous_id): the run that rank changes are measured against, of the same source, format and method: among
    those whose window ended earlier the one that ended last, of several the latest published."""
    earlier = Window.partitionBy("source", "format", "method").orderBy(F.unix_date("ends_before")).rangeBetween(Window.unboundedPreceding, -1)
    return runs.select("run_id", F.max(F.struct("ends_before", "made", "run_id")).over(earlier)["run_id"].alias("previous_id"))


def windows(runs: DataFrame) -> DataFrame:
    """One run for each source, format and window: the active one, else the latest published."""
    return latest(runs, ["source", "format", "starts_on", "ends_before"], [F.desc("active"), F.desc("made"), F.col("run_id")])


def keyset(rows: DataFrame, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """The page after (name_key, card_id), with one row more to tell whether another page follows.  The
    comparison is spelled out, so that it reaches the scan."""
    if after:
        rows = rows.where((F.col("name_key") > after[0]) | ((F.col("name_key") == after[0]) & (F.col("card_id") > after[1])))
    return rows.orderBy("name_key", "card_id").limit(limit + 1)


def top_percent(ranked_rows: DataFrame) -> DataFrame:
    """Scored cards with the ``Top x%`` that they are in, at least 1."""
    ranked_rows = cut(ranked_rows)
    scored = ranked_rows.groupBy("format").agg(F.count("score").alias("scored"))  # one row a run
    label = F.greatest(F.lit(1), F.ceil(F.lit(100) * F.col("ranking") / F.col("scored")))
    return ranked_rows.join(F.broadcast(scored), "format").where(F.col("score").isNotNull()).withColumn("top", label.cast("long")).drop("scored")
