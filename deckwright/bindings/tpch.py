"""The canonical schema over the shared star-schema tables.

events(event_id, occurred_on, format, players, decklists), decks(deck_id, event_id, label, source_ord, complete),
deck_cards(deck_id, card_id, copies), standings(deck_id, wins, losses, draws, made_cut), cards(card_id, name,
type_line, oracle_text, colors, faces), printings(printing_id, card_id, set_code, collector_number, rarity, language, games,
digital, oversized, set_type, border_color, released_on, usd, usd_foil, usd_etched), sideboards(deck_id, card_id, copies),
commanders(deck_id, pos, card_id).  An event is a region's month of orders, a deck an order with lines, a card a part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import cents, hundredths
from ..operators.cohort import BASIC_LANDS

#: Orders whose decklist counts as incomplete.
INCOMPLETE = 97
#: Types that parts take in turn, before their own kind; every fortieth part is one of the basic lands.
TYPES = ("Creature", "Artifact Creature", "Artifact Land", "Instant // Land", "Legendary Planeswalker", "Enchantment", "Sorcery", "Conspiracy", "Battle", "Artifact", "Tribal Instant")
BASIC_EVERY = 40


class Tables:
    """The canonical tables; each is a plan, nothing runs here."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entries(self) -> DataFrame:
        """Orders with their event."""
        # customers, nations and regions are dimensions; Spark broadcasts those that are small
        place = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        month = F.trunc(F.col("o_orderdate").cast("date"), "month")
        return self.raw("orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("deck_id"), F.concat_ws("-", "r_name", F.date_format(month, "yyyy-MM")).alias("event_id"), month.alias("occurred_on"), F.col("r_name").alias("format"),
            "c_mktsegment", "o_orderstatus", "o_orderpriority",
        )

    @cached_property
    def deck_cards(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id")).agg((F.min("l_quantity").cast("int") % 4 + 1).alias("copies"))

    @cached_property
    def decks(self) -> DataFrame:
        listed = self.raw("lineitem").select(F.col("l_orderkey").alias("deck_id")).distinct()
        return self.entries.join(listed, "deck_id", "left_semi").select(
            "deck_id", "event_id", F.when(F.col("deck_id") % 5 != 0, F.col("c_mktsegment")).alias("label"), F.col("deck_id").alias("source_ord"), (F.col("deck_id") % INCOMPLETE != 0).alias("complete")
        )

    @cached_property
    def events(self) -> DataFrame:
        listed = self.raw("lineitem").select(F.col("l_orderkey").alias("deck_id"), F.lit(1).alias("listed")).distinct()
        return self.entries.join(listed, "deck_id", "left").groupBy("event_id", "occurred_on", "format").agg(F.count("*").alias("players"), F.count("listed").alias("decklists"))

    @cached_property
    def standings(self) -> DataFrame:
        known = F.col("o_orderstatus") != "P"
        k = F.col("deck_id")
        place = F.substring("o_orderpriority", 1, 1)
        return self.entries.select(
            "deck_id", "event_id",
            F.when(known, k % 7).cast("int").alias("wins"), F.when(known, F.floor(k / 7) % 5).cast("int").alias("losses"), F.when(known, F.floor(k / 35) % 3).cast("int").alias("draws"),
            F.when(place.isin("1", "2"), True).when(place.isin("3", "4"), False).alias("made_cut"),
        )

    @cached_property
    def cards(self) -> DataFrame:
        colors = F.filter(F.array(*[F.when(F.col("p_size").bitwiseAND(1 << i) != 0, F.lit(c)) for i, c in enumerate("WUBRG")]), lambda x: x.isNotNull())
        k, lands = F.col("p_partkey"), sorted(BASIC_LANDS)
        name = F.when(k % BASIC_EVERY == 0, F.element_at(F.array(*map(F.lit, lands)), (F.floor(k / BASIC_EVERY) % len(lands) + 1).cast("int"))).otherwise(F.col("p_name"))
        kind = F.concat(F.element_at(F.array(*map(F.lit, TYPES)), (k % len(TYPES) + 1).cast("int")), F.lit(" \u2014 "), F.initcap("p_type"))
        # cards of two faces have neither a type nor a text of their own
        two = k % 9 == 0
        face = lambda types, text: F.struct(types.alias("type_line"), text.alias("oracle_text"))
        faces = F.when(two, F.array(face(kind, F.col("p_name")), face(F.lit("Sorcery"), F.col("p_brand"))))
        return self.raw("part").select(k.alias("card_id"), name.alias("name"), F.when(~two, kind).alias("type_line"), F.when(~two, F.concat_ws(" ", "p_name", "p_brand")).alias("oracle_text"), F.when(F.col("p_size") % 7 != 0, colors).alias("colors"), faces.alias("faces"))

    @cached_property
    def printings(self) -> DataFrame:
        # a pair is rarely sold twice, so lines go to their card at once, where joins and aggregates of cards find them
        sold = self.raw("lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").cast("date").alias("released_on"), F.min(hundredths(F.col("l_extendedprice"))).alias("price"))
        k = F.col("l_partkey") + F.col("l_suppkey")
        rarity = F.element_at(F.array(*map(F.lit, ("common", "uncommon", "rare", "mythic"))), (k % 4 + 1).cast("int"))
        usd = cents(F.col("price") / 1000)
        own_set = F.concat(F.when(F.col("l_suppkey") % 4 == 0, F.lit("p")).otherwise(F.lit("")), F.lit("S"), (F.col("s_nationkey") % 3).cast("string"))
        number = F.concat(F.when(k % 17 == 0, F.lit("A")).otherwise(F.lit("")), (F.col("l_suppkey") % 90).cast("string"), F.when(k % 5 == 0, F.lit("b")).otherwise(F.lit("")))
        day = F.when(k % 13 == 0, F.trunc("released_on", "year")).when(k % 29 != 0, F.col("released_on"))
        return sold.join(self.raw("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
            (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("printing_id"), F.col("l_partkey").alias("card_id"), own_set.alias("set_code"), number.alias("collector_number"), rarity.alias("rarity"),
            F.when(F.col("l_suppkey") % 3 != 0, "en").otherwise("ja").alias("language"),
            F.when(k % 5 == 0, F.array(F.lit("online"))).otherwise(F.array(F.lit("paper"), F.lit("online"))).alias("games"),
            (k % 19 == 0).alias("digital"), (k % 23 == 0).alias("oversized"), F.when(k % 31 == 0, "memorabilia").otherwise("core").alias("set_type"), F.when(k % 37 == 0, "gold").otherwise("black").alias("border_color"),
            day.alias("released_on"), F.when(k % 7 == 0, F.lit(0).cast("decimal(12,2)")).when(k % 11 != 0, usd).alias("usd"), F.when(k % 3 == 0, (usd * 2).cast("decimal(12,2)")).alias("usd_foil"), F.when(k % 4 == 1, (usd - 1).cast("decimal(12,2)")).alias("usd_etched"),
        )

    @cached_property
    def sideboards(self) -> DataFrame:
        """Lines that came back, with the same card twice as one."""
        return self.raw("lineitem").where("l_returnflag = 'R' AND l_linenumber > 3").groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id")).agg((F.min("l_quantity").cast("int") % 3 + 1).alias("copies"))

    @cached_property
    def commanders(self) -> DataFrame:
        """The one or two cards of greatest quantity of decks without a label."""
        best = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id")).agg(F.max("l_quantity").alias("q"))
        rank = F.row_number().over(Window.partitionBy("deck_id").orderBy(F.desc("q"), "card_id"))
        top = best.where(F.col("deck_id") % 5 == 0).withColumn("n", rank).where(F.col("n") <= F.col("deck_id") % 2 + 1)
        return top.select("deck_id", F.col("n").alias("pos"), "card_id")

    @cached_property
    def pairings(self) -> DataFrame:
        """Matches of three rounds: deck k meets k + 1, k + 2 and k + 3 where these are listed.  Every fourth is reported from
        the other seat as well, later, and wrongly."""
        k, rounds = F.col("deck_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("round")
        own = self.decks.select("event_id", "deck_id", rounds).where(k % (F.col("round") * 2) < F.col("round"))
        own = own.select("event_id", "round", "deck_id", (k + F.col("round")).alias("opponent"), F.element_at(F.array(*map(F.lit, ("won", "lost", "drew"))), (k % 3 + 1).cast("int")).alias("result"))
        met = own.join(self.decks.select(F.col("deck_id").alias("opponent")), "opponent", "left_semi")
        reports = F.array(F.struct(F.lit(1).alias("seen"), k.alias("deck"), F.col("opponent").alias("opponent"), F.col("result").alias("result")), F.struct(F.lit(2).alias("seen"), F.col("opponent").alias("deck"), k.alias("opponent"), F.lit("won").alias("result")))
        told = F.explode(F.when(k % 4 == 0, reports).otherwise(F.slice(reports, 1, 1)))
        return met.select("event_id", "round", told.alias("x")).select("event_id", "round", "x.*")

    @cached_property
    def price_history(self) -> DataFrame:
        """(card_id, day, price): what was asked for a card on a day, several times on some."""
        return self.raw("lineitem").select(F.col("l_partkey").alias("card_id"), F.col("l_shipdate").cast("date").alias("day"), F.floor("l_extendedprice").cast("long").alias("price"))

    @cached_property
    def runs(self) -> DataFrame:
        """Published runs of every year that a format has events in: two of the whole year, one of its first half, which
        in even years scored by another method."""
        year, n = F.year("occurred_on"), F.col("n")
        rows = self.events.select("format", year.alias("y")).distinct().select("format", "y", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
        half = n == 3
        return rows.select(
            F.concat_ws("-", "format", F.col("y").cast("string"), n.cast("string")).alias("run_id"), F.lit("orders").alias("source"), "format", F.when(half & (F.col("y") % 2 == 0), "signature").otherwise("constructed").alias("method"),
            F.make_date("y", F.lit(1), F.lit(1)).alias("starts_on"), F.when(half, F.make_date("y", F.lit(7), F.lit(1))).otherwise(F.make_date(F.col("y") + 1, F.lit(1), F.lit(1))).alias("ends_before"),
            ((F.col("y") * 7 + n * 5) % 11).alias("made"), ((n == 1) & (F.col("y") % 3 == 0)).alias("active"),
        )

    @cached_property
    def spelled_lines(self) -> DataFrame:
        """(deck_id, card_id, name): main-deck cards as the decks spell them, every third with what stands on the back."""
        back = F.when(F.col("deck_id") % 3 == 0, F.concat("name", F.lit(" // Back"))).otherwise(F.col("name"))
        return self.deck_cards.join(self.cards.select("card_id", "name"), "card_id").select("deck_id", "card_id", back.alias("name"))

    @cached_property
    def raw_cards(self) -> DataFrame:
        """Printings as the objects of a card file: some without a card, some with too few faces, one in ten twice.  Suppliers
        of six digits reach into the next card's numbers, so there the card follows a slash, which sorts before digits."""
        p = self.printings.join(self.cards, "card_id")
        k = F.col("printing_id")
        own = F.when(k - F.col("card_id") * 100000 < 100000, k.cast("string")).otherwise(F.concat_ws("/", k.cast("string"), F.col("card_id").cast("string")))
        none = F.lit(None).cast("string")

        def face(f: Column) -> Column:
            own = {"name": F.concat(F.lit("Face "), f["type_line"]), "mana_cost": none, "type_line": f["type_line"], "oracle_text": f["oracle_text"], "colors": F.when(k % 2 == 0, F.array(F.lit("G"), F.lit("W"))), "image_uris": F.create_map(F.lit("normal"), F.lit("u")), "artist": none}
            return F.named_struct(*[x for name, value in own.items() for x in (F.lit(name), value)])

        faces = F.transform(F.when(k % 47 == 0, F.slice("faces", 1, 1)).otherwise(F.col("faces")), face)
        rows = p.select(
            own.alias("id"), F.when(k % 101 != 0, F.col("card_id").cast("string")).alias("oracle_id"), "name", F.when(F.col("faces").isNotNull(), "transform").otherwise("normal").alias("layout"), F.col("language").alias("lang"),
            F.col("released_on").cast("string").alias("released_at"), F.col("set_code").alias("set"), F.col("set_code").alias("set_name"), "collector_number", "rarity", "games", F.lit(None).cast("double").alias("cmc"), F.lit(None).cast("string").alias("mana_cost"),
            "type_line", "oracle_text", F.when(F.col("faces").isNull(), F.col("colors")).alias("colors"), F.array().cast("array<string>").alias("color_identity"), F.lit(None).cast("map<string,string>").alias("image_uris"), F.lit(None).cast("string").alias("artist"), faces.alias("card_faces"), F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time"),
        )
        return rows.drop("time")
