"""From raw tournament responses to the canonical tables, and names to cards and players to decks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rate
from ..functions.text import loose_key, name_key, unaccented_key
from .serving import latest


def count_or_null(value: Column) -> Column:
    """A non-negative whole number, or unknown."""
    return F.when(value >= 0, value.cast("long"))


def cut_size(text: Column) -> Column:
    """``"8"`` is 8, absent is 0, anything else (``"8-0"``) is unknown."""
    return F.when(text.isNull(), F.lit(0)).when(text.rlike(r"^[0-9]{1,6}$"), text.try_cast("int"))


def uuid_or_null(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), low)


def coverage_class(observed: Column, expected: Column) -> Column:
    return F.when(expected.isNull() | (expected <= 0) | observed.isNull(), "UNKNOWN").when(observed <= 0, "NONE").when(observed < expected, "PARTIAL").otherwise("FULL_FIELD")


def event_projection(events: DataFrame) -> DataFrame:
    """Events with the share of decklists that was seen and its class."""
    return events.select("event_id", "occurred_on", "format", "players", "decklists", rate(F.col("decklists"), F.when(F.col("players") > 0, F.col("players"))).alias("coverage"), coverage_class(F.col("decklists"), F.col("players")).alias("class"))


def zone_totals(lines: DataFrame) -> DataFrame:
    """(deck_id, zone, card_id or NULL, copies or NULL) to the usable lines and copies of each deck's zones and the
    lines that are set aside, as they have no usable id or no positive count."""
    usable = F.col("card_id").isNotNull() & (F.col("copies") > 0)
    return lines.groupBy("deck_id", "zone").agg(F.count(F.when(usable, 1)).alias("cards"), F.coalesce(F.sum(F.when(usable, F.col("copies"))), F.lit(0)).cast("long").alias("copies"), F.count(F.when(F.coalesce(usable, F.lit(False)), None).otherwise(1)).alias("skipped"))


#: Fixed value: a deck of more commanders has none that can be told.
MAX_COMMANDERS = 2


def deck_entries(lines: DataFrame) -> DataFrame:
    """(event_id, position, label, zone 'main', 'side' or 'commander', name, card_id, copies) to one row a deck with a main
    part: ``cards`` (card_id, main, side; commanders count as main), ``commanders`` in order, none if there are more than
    MAX_COMMANDERS, whether the whole ``sideboard_observed`` is known, and the entries set aside."""
    usable = F.col("card_id").isNotNull() & F.col("copies").isNotNull()
    side = F.col("zone") == "side"
    deck = ["event_id", "position"]
    copies = lambda zone: F.coalesce(F.sum(F.when(zone, F.col("copies"))), F.lit(0)).cast("long")
    cards = lines.where(usable).groupBy(*deck, "card_id").agg(copies(~side).alias("main"), copies(side).alias("side"), F.max((F.col("zone") == "commander")).alias("leads"))
    held = cards.groupBy(*deck).agg(F.array_sort(F.collect_list(F.struct("card_id", "main", "side"))).alias("cards"), F.array_sort(F.collect_set(F.when(F.col("leads"), F.col("card_id")))).alias("leaders"))
    about = lines.groupBy(*deck).agg(
        F.first("label").alias("label"), F.count_if(~usable & ~side).alias("skipped_main"), F.count_if(~usable & side).alias("skipped_side"), F.max(side).alias("has_side"), F.max(F.col("zone") == "main").alias("has_main")
    )
    none = F.array().cast("array<string>")
    leaders = F.when(F.size("leaders") <= MAX_COMMANDERS, F.col("leaders")).otherwise(none)
    return about.where("has_main").join(held, deck, "left").select(*deck, "label", F.coalesce("cards", F.array().cast(held.schema["cards"].dataType)).alias("cards"), F.coalesce(leaders, none).alias("commanders"), (F.col("has_side") & (F.col("skipped_side") == 0)).alias("sideboard_observed"), "skipped_main", "skipped_side")


def infer_cut(rows: DataFrame) -> DataFrame:
    """(event_id, position, wins, bracket_wins, bracket_losses, cut_size) gains made_cut and its basis."""
    per = rows.groupBy("event_id").agg(
        F.max("cut_size").alias("size"), F.count("*").alias("n"), F.count(F.when(F.col("bracket_wins").isNotNull() & F.col("bracket_losses").isNotNull(), 1)).alias("bracketed"), F.count("wins").alias("with_wins"),
        F.min(F.when(F.col("position") < F.col("cut_size"), F.col("wins"))).alias("least_in"), F.max(F.when(F.col("position") >= F.col("cut_size"), F.col("wins"))).alias("most_out"),
    )
    basis = (
        F.when(F.col("size").isNull(), "unknown_top_cut").when(F.col("size") == 0, "no_top_cut").when(F.col("bracketed") == F.col("n"), "bracket_record")
        .when((F.col("with_wins") < F.col("n")) | ((F.col("n") > F.col("size")) & (F.col("least_in") < F.col("most_out"))), "inconsistent_order").otherwise("standing_order")
    )
    judged = rows.join(per.select("event_id", basis.alias("basis")), "event_id")
    made = F.when(F.col("basis") == "bracket_record", F.col("bracket_wins") + F.col("bracket_losses") > 0).when(F.col("basis") == "standing_order", F.col("position") < F.col("cut_size"))
    return judged.withColumn("made_cut", made)


def unique_events(rows: DataFrame) -> DataFrame:
    """Each event once; the same id with different content is an error."""
    content = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"])), 256)
    seen = rows.withColumn("_h", content)
    versions = seen.groupBy("event_id").agg(F.countDistinct("_h").alias("_versions"))
    checked = seen.dropDuplicates(["event_id"]).join(versions, "event_id")
    return checked.withColumn("event_id", F.when(F.col("_versions") > 1, F.raise_error(F.concat(F.lit("conflicting event "), F.col("event_id")))).otherwise(F.col("event_id"))).drop("_h", "_versions")


def resolve_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name) to (name, card_id, pass): exact key, then without accents, then letters and digits only; a
    canonical name beats a face, and only one match resolves."""
    rows = names.select("name").distinct()
    out = None
    for n, key in enumerate((name_key, unaccented_key, loose_key)):
        left = rows.select("name", key(F.col("name")).alias("k"))
        right = aliases.select(key(F.col("alias_key")).alias("k"), "card_id", (F.col("kind") != "canonical").cast("int").alias("face"))
        step = left.join(right, "k").select("name", "card_id", F.struct(F.lit(n).alias("n"), "face").alias("rank"))
        out = step if out is None else out.unionByName(step)
    best = out.groupBy("name").agg(F.min("rank").alias("best"))
    chosen = out.join(best, "name").where(F.col("rank") == F.col("best")).groupBy("name").agg(F.collect_set("card_id").alias("ids"), F.min("best").alias("best"))
    found = chosen.where(F.size("ids") == 1).select("name", F.col("ids")[0].alias("card_id"), (F.col("best.n") + 1).alias("pass"))
    return rows.join(found, "name", "left")


def pairing_records(rounds: DataFrame) -> DataFrame:
    """(event_id, round, page_ord, player, opponent, result 'won'|'lost'|'drew'|'bye') to wins, losses, draws and
    byes of each player; a pairing seen from both sides counts once, as it was first seen."""
    a, b = F.least("player", F.coalesce("opponent", "player")), F.greatest("player", F.coalesce("opponent", "player"))
    once = latest(rounds.withColumns({"_a": a, "_b": b}), ["event_id", "round", "_a", "_b"], [F.col("page_ord")])
    turned = F.create_map(*[F.lit(x) for x in ("won", "lost", "lost", "won", "drew", "drew")])
    seats = once.select("event_id", F.explode(F.array(F.struct(F.col("player").alias("p"), F.col("result").alias("r")), F.struct(F.col("opponent").alias("p"), F.try_element_at(turned, F.col("result")).alias("r")))).alias("s")).select("event_id", F.col("s.p").alias("player"), F.col("s.r").alias("r")).where("player IS NOT NULL AND r IS NOT NULL")
    return seats.groupBy("event_id", "player").agg(*[F.count(F.when(F.col("r") == r, 1)).alias(n) for r, n in (("won", "wins"), ("lost", "losses"), ("drew", "draws"), ("bye", "byes"))])


def resolution(lines: DataFrame) -> DataFrame:
    """(event_id, card_id or NULL, copies): the share of lines and of copies that resolved."""
    known = F.col("card_id").isNotNull()
    return lines.groupBy("event_id").agg(F.count("*").alias("lines"), F.count("card_id").alias("resolved_lines"), F.sum("copies").cast("long").alias("copies"), F.coalesce(F.sum(F.when(known, F.col("copies"))), F.lit(0)).cast("long").alias("resolved_copies")).withColumns({"line_share": rate(F.col("resolved_lines"), F.col("lines")), "copy_share": rate(F.col("resolved_copies"), F.col("copies"))})
