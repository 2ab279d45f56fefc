"""Cohorts: which events, decks and standings a run is about, and why the others are not.

Rules are a small DataFrame (format, starts_on, ends_before, min_coverage, players_per_game), one row a run, so
all runs are selected in one pass.  Every later operator keeps ``format`` as its run key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import rate


def judged(events: DataFrame, rules: DataFrame, excluded: DataFrame) -> DataFrame:
    """Events with ``reason``: the first rule that fails, or NULL for those in the cohort."""
    known = rules.select("format", "starts_on", "ends_before", "min_coverage", "players_per_game")
    listed = excluded.select("event_id", F.col("reason").alias("listed"))
    coverage = rate(F.col("decklists"), F.col("players"))
    reason = (
        F.when(F.col("listed").isNotNull(), F.concat(F.lit("listed: "), "listed"))
        .when(F.col("starts_on").isNull(), "format")
        .when((F.col("occurred_on") < F.col("starts_on")) | (F.col("occurred_on") >= F.col("ends_before")), "window")
        .when(coverage.isNull(), "coverage unknown")
        .when(coverage < F.col("min_coverage"), "coverage low")
    )
    return events.join(known, "format", "left").join(listed, "event_id", "left").withColumns({"coverage": coverage, "reason": reason})


def in_windows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (format, occurred_on) that a run's format and window leave in: of other events, :func:`judged` says ``format`` or
    ``window`` whatever else is known of them."""
    own, run = rows.alias("own"), F.broadcast(rules.select("format", "starts_on", "ends_before")).alias("run")
    outside = (F.col("own.occurred_on") < F.col("run.starts_on")) | (F.col("own.occurred_on") >= F.col("run.ends_before"))
    return own.join(run, (F.col("own.format") == F.col("run.format")) & F.col("run.starts_on").isNotNull() & ~F.coalesce(outside, F.lit(False)), "left_semi")


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rules, excluded) from saved rule files: one JSON object each, two players a game unless it says so."""
    schema = "version string, format_name string, starts_on date, ends_before date, min_decklist_coverage double, players_per_game int, excluded_events array<struct<source_event_id:string,reason:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rules = rows.select(F.col("format_name").alias("format"), "starts_on", "ends_before", F.col("min_decklist_coverage").alias("min_coverage"), F.coalesce("players_per_game", F.lit(2)).alias("players_per_game"), "version")
    excluded = rows.select(F.explode("excluded_events").alias("x")).select(F.col("x.source_event_id").alias("event_id"), "x.reason").distinct()
    return rules, excluded


#: Basic lands, which would lead every ranking by volume and so aren't scored.
BASIC_LANDS = ("Forest", "Island", "Mountain", "Plains", "Snow-Covered Forest", "Snow-Covered Island", "Snow-Covered Mountain", "Snow-Covered Plains", "Snow-Covered Swamp", "Snow-Covered Wastes", "Swamp", "Wastes")


def scored_population(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows of cards that are scored: all main-deck cards but the basic lands.  How they are joined is left to Spark, which
    broadcasts the lands if they are as few as they should be."""
    return rows.join(cards.where(F.col("name").isin(*BASIC_LANDS)).select("card_id"), "card_id", "left_anti")


def one_version(rows: DataFrame, column: str = "version") -> DataFrame:
    """(format, version): the versions that made a run's parts, joined by ``+`` in order."""
    return rows.groupBy("format").agg(F.array_join(F.array_sort(F.collect_set(column)), "+").alias(column))


def require_one(rows: DataFrame, column: str) -> str:
    """The single value of a column of a few rows; several are an error."""
    found = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"one {column} is needed, not {found}")
    return found[0]


@dataclass(frozen=True)
class Cohort:
    """The parts of all runs; decks and standings carry format, occurred_on and the run's window."""

    events: DataFrame
    decks: DataFrame
    incomplete: DataFrame
    standings: DataFrame


def select(events: DataFrame, decks: DataFrame, standings: DataFrame, rules: DataFrame, excluded: DataFrame) -> Cohort:
    chosen = judged(events, rules, excluded).where(F.col("reason").isNull()).drop("reason", "listed", "coverage")
    run = chosen.select("event_id", "format", "occurred_on", "ends_before", "starts_on", "players_per_game")
    own = decks.join(run, "event_id")
    return Cohort(chosen, own.where("complete"), own.where(~F.col("complete")), standings.join(run, "event_id"))


def totals(cohort: Cohort) -> DataFrame:
    """One row a run: events, players, decks, incomplete decks, cut results and games."""
    by = "format"
    events = cohort.events.groupBy(by).agg(F.count("*").alias("events"), F.sum("players").alias("players"))
    decks = cohort.decks.groupBy(by).agg(F.count("*").alias("decks"))
    incomplete = cohort.incomplete.groupBy(by).agg(F.count("*").alias("incomplete_decks"))
    made = F.col("made_cut").cast("int")
    results = cohort.standings.groupBy(by).agg(F.count("made_cut").alias("cut_known"), F.sum(made).alias("cut_made"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.sum("draws").alias("draws"))
    return events.join(decks, by, "left").join(incomplete, by, "left").join(results, by, "left").select(
        by, "events", "players", F.coalesce("decks", F.lit(0)).alias("decks"), F.coalesce("incomplete_decks", F.lit(0)).alias("incomplete_decks"), F.coalesce("cut_known", F.lit(0)).alias("cut_known"), "cut_made", "wins", "losses", "draws"
    )
