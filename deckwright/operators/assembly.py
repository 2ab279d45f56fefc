"""Facts of saved events out of their pages: the field, its decks, standings, records and what of it all was seen.

Pages (event_id, format, occurred_on, rounds, ord, slug, text) become rows by joins and aggregates within their event;
every event of every folder is assembled in the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..sources import files
from . import ingest, players

#: The page of final standings, and the size of the last cut of these events.
STANDINGS_PAGE, TOP_CUT = "standfin", 8


@dataclass(frozen=True)
class Facts:
    """``events`` (players, cut size and its basis, coverage of decklists, standings and rounds), ``decks`` (in published
    order, with their label and what stayed unresolved), ``cards`` of decks, ``standings`` of decks that a player of the
    field was found for, and names of cards that nothing or several things bear."""

    events: DataFrame
    decks: DataFrame
    cards: DataFrame
    standings: DataFrame
    unresolved: DataFrame


def keyed(pages: DataFrame, *more: str) -> DataFrame:
    """(file, text), the file standing for event and page, and for more that a page's rows are to keep."""
    return pages.select(F.struct("event_id", "slug", *more).alias("file"), "text")


def of_page(rows: DataFrame) -> DataFrame:
    return rows.select("file.*", *[c for c in rows.columns if c != "file"])


def result_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, round, slug) of the rounds that count, each from the last page that reports it; and (event_id,
    expected, found) of every event.  Those of the event's format count, or without such a list all up to the last."""
    numbered = pages.withColumn("round", files.result_round(F.col("slug"))).where("round IS NOT NULL")
    last = numbered.groupBy("event_id", "round").agg(F.max_by("slug", "ord").alias("slug"))
    highest = last.groupBy("event_id").agg(F.max("round").alias("highest"))
    told = pages.groupBy("event_id").agg(F.first("rounds").alias("rounds"))
    every = told.join(highest, "event_id", "left").select(
        "event_id", F.explode_outer(F.when(F.col("rounds").isNotNull(), F.array_distinct("rounds")).when(F.col("highest") > 0, F.sequence(F.lit(1), "highest"))).alias("round")
    )
    counted = every.join(last, ["event_id", "round"], "left")
    rounds = counted.groupBy("event_id").agg(F.count("round").alias("expected"), F.count("slug").alias("found"))
    return counted.where("slug IS NOT NULL"), rounds


def listed_decks(pages: DataFrame) -> DataFrame:
    """(event_id, number, player, label, cards (zone, name, copies)): a player on two pages has one deck, that of the first
    page that lists it; decks are numbered from 1 in the order of pages and within them."""
    order = files.deck_pages(pages.select("event_id", "slug"))
    decks = cut(of_page(files.page_lists(keyed(pages.join(order, ["event_id", "slug"]), "place"))))
    decks = players.with_parts(decks, "player").withColumn("who", F.array_join("words", " ")).drop("first", "last", "words")
    # a field's decks go to its event once
    again = F.row_number().over(Window.partitionBy("event_id", "who").orderBy("place", "deck"))
    first = decks.repartition("event_id").withColumn("again", again).where("again = 1")
    number = F.row_number().over(Window.partitionBy("event_id").orderBy("place", "deck"))
    return first.withColumn("number", number).select("event_id", "number", "player", "label", "cards")


def assemble(pages: DataFrame, aliases: DataFrame) -> Facts:
    """The facts of all events of ``pages``; ``aliases`` as for :func:`ingest.resolve_names`."""
    # what is read several times below is written once: rows of tables, decks' lines, names and their matches
    # pages of one kind may come in few partitions, and each kind is read by itself, so they are dealt out first
    pages = cut(pages.where(F.col("slug").isNotNull()).repartition("event_id", "slug"))
    rounds, seen = result_pages(pages)
    rounds = cut(rounds)
    reported = of_page(files.results(files.table_rows(keyed(pages.join(rounds, ["event_id", "slug"]), "round"))))
    reported = cut(reported.where("result <> 'unread'").select("event_id", "round", F.col("row_ord").alias("page_ord"), "player", "opponent", "result"))
    final = of_page(files.standings_rows(files.table_rows(keyed(pages.where(F.col("slug") == STANDINGS_PAGE)))))
    # a name that stands twice keeps its last place
    ranks = cut(final.groupBy("event_id", "player").agg(F.max("place").alias("place")))

    present = reported.select("event_id", "round", F.explode(F.array("player", "opponent")).alias("name")).where("name IS NOT NULL")
    same = cut(players.spellings(present, ranks.select("event_id", F.col("player").alias("name"))))
    spelled = reported
    for side in ("player", "opponent"):
        known = same.select("event_id", F.col("name").alias(side), F.col("player").alias("known"))
        spelled = spelled.join(known, ["event_id", side], "left").withColumn(side, F.coalesce("known", side)).drop("known")
    spelled = cut(spelled)
    record = ingest.pairing_records(spelled).drop("byes")
    byes = spelled.where("result = 'bye'").select("event_id", "player", F.lit(1).alias("byes"))
    told = ranks.unionByName(record, allowMissingColumns=True).unionByName(byes, allowMissingColumns=True)
    # a place and a record come from one row each, byes from one each
    once = [F.max(c).alias(c) for c in ("place", "wins", "losses", "draws")]
    roster = cut(told.groupBy("event_id", "player").agg(*once, F.sum("byes").alias("byes")))

    listed = cut(listed_decks(pages))
    heads = listed.drop("cards")
    lines = listed.select("event_id", "number", F.explode("cards").alias("card")).select("event_id", "number", "card.*")
    sides = heads.select("event_id", F.lit("deck").alias("side"), F.col("player").alias("name"), F.col("number").alias("ord")).unionByName(roster.select("event_id", F.lit("standing").alias("side"), F.col("player").alias("name"), F.lit(0).alias("ord")))
    joined = players.match(sides)

    resolved = cut(ingest.resolve_names(cut(lines.select("name").distinct()), aliases))
    zone = lambda z, value: F.coalesce(F.sum(F.when(F.col("zone") == z, value)), F.lit(0)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    lost = lines.join(resolved.where("card_id IS NULL").select("name"), "name").groupBy("event_id", "number").agg(zone("main", F.lit(1)).alias("skipped_main"), zone("side", F.lit(1)).alias("skipped_side"))
    per_deck = listed.withColumn("has_side", F.exists("cards", lambda x: x["zone"] == "side")).drop("cards").join(lost, ["event_id", "number"], "left").withColumns({c: zero(F.col(c)) for c in ("skipped_main", "skipped_side")})
    decks = per_deck.select(
        "event_id", "number", "player", "label", "skipped_main", "skipped_side", (F.col("skipped_main") == 0).alias("complete"), (F.col("has_side") & (F.col("skipped_side") == 0)).alias("sideboard_observed")
    )
    known = resolved.where("card_id IS NOT NULL").select("name", "card_id")
    cards = lines.join(known, "name").groupBy("event_id", "number", "card_id").agg(zone("main", F.col("copies")).alias("main"), zone("side", F.col("copies")).alias("side"))

    field = roster.groupBy("event_id").agg(F.count("*").alias("players"), F.count("place").alias("ranked"), (F.count(F.when(F.col("place") <= TOP_CUT, 1)) == TOP_CUT).alias("cut"))
    lists = heads.groupBy("event_id").agg(F.count("*").alias("decklists"))
    about = pages.groupBy("event_id").agg(F.first("format").alias("format"), F.first("occurred_on").alias("occurred_on"))
    events = about.join(field, "event_id", "left").join(lists, "event_id", "left").join(seen, "event_id", "left").withColumn("players", zero("players"))
    coverage = lambda got, of: ingest.coverage_class(got, of)
    events = events.select(
        "event_id", "format", "occurred_on", F.nullif("players", F.lit(0)).alias("players"), zero("decklists").alias("decklists"), F.when(F.col("cut"), TOP_CUT).alias("cut_size"), F.when(F.col("cut"), "standing_order").otherwise("unknown_top_cut").alias("cut_basis"),
        # a page can list a deck whose player the standings lost
        coverage(F.least(zero("decklists"), F.col("players")), F.col("players")).alias("decklist_coverage"), coverage(zero("ranked"), F.col("players")).alias("standings_coverage"),
        F.when(F.col("expected") == 0, "NONE").otherwise(coverage(F.col("found"), F.col("expected"))).alias("match_coverage"), ((F.col("found") > 0) & (F.col("found") == F.col("expected"))).alias("rounds_complete"),
    )
    # records count only if every round that should count was saved
    whole = events.select("event_id", F.col("rounds_complete").alias("whole"), F.col("cut_size").isNotNull().alias("cut"))
    placed = heads.select("event_id", "number", F.col("player").alias("deck_name")).join(joined, ["event_id", "deck_name"]).join(roster.withColumnRenamed("player", "standing_name"), ["event_id", "standing_name"]).join(whole, "event_id")
    kept = lambda c: F.when(F.col("whole"), zero(c)).alias(c)
    standings = placed.select("event_id", "number", F.col("standing_name").alias("player"), F.col("pass").alias("joined_by"), F.col("place").alias("final_rank"), kept("wins"), kept("losses"), kept("draws"), kept("byes"), F.when(F.col("cut") & F.col("place").isNotNull(), F.col("place") <= TOP_CUT).alias("made_cut"))
    # cards are a plan that who reads them runs: the other facts don't need them
    events, decks, standings = (cut(x) for x in (events, decks, standings))
    return Facts(events, decks, cards, standings, resolved.where("card_id IS NULL").select("name"))


def join_methods(facts: Facts) -> DataFrame:
    """(method, decks): how decks found their players, and those that didn't."""
    how = F.element_at(F.array(*map(F.lit, players.PASSES)), F.col("joined_by"))
    found = facts.decks.select("event_id", "number").join(facts.standings.select("event_id", "number", how.alias("method")), ["event_id", "number"], "left")
    return found.groupBy(F.coalesce("method", F.lit("unmatched")).alias("method")).agg(F.count("*").alias("decks"))
