"""The card catalogue: representative printings, joint predicates on one printing, search, prices, aliases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import ascii_name_key


def representative(printings: DataFrame) -> DataFrame:
    """Of each card: English first, then newest (no date: last), then the least id."""
    key = F.struct((F.col("language") != "en").alias("a"), F.coalesce(F.datediff(F.lit("1970-01-01").cast("date"), "released_on"), F.lit(2**31 - 1)).alias("b"), F.col("printing_id").alias("c"))
    return printings.groupBy("card_id").agg(F.min_by(F.struct("printing_id", "set_code", "language", "released_on"), key).alias("p")).select("card_id", "p.*")


def leading_number(text: Column) -> Column:
    """The number that a text starts with; NaN, which sorts last, if it starts with none."""
    return F.coalesce(F.regexp_extract(text, r"^[0-9]+", 0).try_cast("double"), F.lit(float("nan")))


def with_original_key(printings: DataFrame) -> DataFrame:
    """The printings with ``original``, their place in the order of originals: English, paper, promos of a set that
    the card is in after it, oldest (a date of only a year counts from the year's end), collector number, id."""
    own_sets = F.collect_set("set_code").over(Window.partitionBy("card_id"))  # a card's printings
    promo = F.col("set_code").startswith("p") & F.array_contains(own_sets, F.expr("substring(set_code, 2)"))
    released = F.date_add("released_on", F.when(F.dayofyear("released_on") == 1, 364).otherwise(0))
    key = F.struct(
        (F.col("language") != "en").alias("a"), (~F.array_contains("games", "paper")).alias("b"), promo.alias("c"), F.coalesce(released, F.lit("9999-12-31").cast("date")).alias("d"),
        leading_number(F.col("collector_number")).alias("e"), F.col("collector_number").alias("f"), F.col("printing_id").alias("g"),
    )
    return printings.withColumn("original", key)


def original_first(printings: DataFrame) -> DataFrame:
    """The preview of each card: its first printing in the order of originals, and how many it has."""
    return with_original_key(printings).groupBy("card_id").agg(F.min_by(F.struct("printing_id", "set_code", "released_on"), "original").alias("p"), F.count("*").alias("printings")).select("card_id", "p.*", "printings")


def asked(sets: Sequence[str] = (), rarities: Sequence[str] = (), game: str | None = None) -> Column:
    """What a printing must be: of one of the sets, one of the rarities, and in the game, as far as these are given."""
    keep = F.lit(True)
    if sets:
        keep = keep & F.col("set_code").isin(*sets)
    if rarities:
        keep = keep & F.col("rarity").isin(*rarities)
    if game:
        keep = keep & F.array_contains("games", game)
    return keep


def joint(printings: DataFrame, sets: Sequence[str] = (), rarities: Sequence[str] = (), game: str | None = None) -> DataFrame:
    """Cards with a printing for which all that is asked holds at once, and how many such there are."""
    return printings.where(asked(sets, rarities, game)).groupBy("card_id").agg(F.count("*").alias("eligible"))


def joint_preview(printings: DataFrame, sets: Sequence[str] = (), rarities: Sequence[str] = (), game: str | None = None) -> DataFrame:
    """The same with all printings counted beside them, and the preview: the eligible printing that is first in the order
    of originals.  That order is of all printings, as it asks in which sets the card is."""
    fits = asked(sets, rarities, game)
    per = with_original_key(printings).groupBy("card_id").agg(F.count_if(fits).alias("eligible"), F.count("*").alias("printings"), F.min_by("printing_id", F.when(fits, F.col("original"))).alias("preview"))
    return per.where("eligible > 0")


def playable_in_paper() -> Column:
    """Printings on paper that a deck may hold: no digital, oversized, memorabilia or gold-bordered ones."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.array_contains("games", "paper") & ~flag("digital") & ~flag("oversized") & ~F.col("set_type").eqNullSafe("memorabilia") & ~F.col("border_color").eqNullSafe("gold")


def cheapest(printings: DataFrame) -> DataFrame:
    """The least price above nothing of playable printings over their three finishes, ties to the least id."""
    offers = printings.where(playable_in_paper()).select("card_id", "printing_id", F.explode(F.array("usd", "usd_foil", "usd_etched")).alias("usd")).where("usd > 0")
    return offers.groupBy("card_id").agg(F.min(F.struct("usd", "printing_id")).alias("m")).select("card_id", "m.usd", "m.printing_id")


def aliases(cards: DataFrame) -> DataFrame:
    """(card_id, alias_key, kind): canonical names, and faces of names joined by `` // ``, each once."""
    faces = F.when(F.instr("name", " // ") > 0, F.split("name", " // ")).otherwise(F.array().cast("array<string>"))
    rows = cards.select("card_id", F.explode(F.concat(F.array(F.struct(F.col("name").alias("n"), F.lit("canonical").alias("kind"))), F.transform(faces, lambda x: F.struct(x.alias("n"), F.lit("face").alias("kind"))))).alias("a"))
    return rows.select("card_id", ascii_name_key(F.col("a.n")).alias("alias_key"), "a.kind").distinct()


def on_any_face(column: str, text: str) -> Column:
    """The card's column, or a face's, holds the text, whatever its case."""
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return holds(F.col(column)) | F.coalesce(F.exists("faces", lambda f: holds(f[column])), F.lit(False))


#: What a search looks at: names (aliases), type lines, rules texts, or all of these.
SCOPES = {"name": (), "type": ("type_line",), "text": ("oracle_text",), "all": ("type_line", "oracle_text")}


def search(cards: DataFrame, names: DataFrame, text: str, scope: str = "name") -> DataFrame:
    """Cards that hold the text where the scope looks."""
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope}")
    if scope in ("type", "text"):
        return cards.where(on_any_face(SCOPES[scope][0], text))
    named = names.where(F.instr("alias_key", text.lower()) > 0).select("card_id").distinct()
    if scope == "name":
        return cards.join(named, "card_id", "left_semi")
    marked = cards.join(named.withColumn("named", F.lit(True)), "card_id", "left")
    elsewhere = F.lit(False)
    for column in SCOPES[scope]:
        elsewhere = elsewhere | on_any_face(column, text)
    return marked.where(F.col("named").isNotNull() | elsewhere).drop("named")


#: Card types that a filter may ask for.
CARD_TYPES = ("artifact", "battle", "creature", "enchantment", "instant", "land", "planeswalker", "sorcery")


def type_filter(type_line: Column, kind: str) -> Column:
    """The type, one of a closed set, stands before the dash on any face."""
    if kind not in CARD_TYPES:
        raise ValueError(f"no card type {kind}")
    return F.coalesce(type_line.rlike(rf"(^|//)[^—/]*\b{kind.capitalize()}\b"), F.lit(False))


def deck_group(type_line: Column) -> Column:
    """The group that a deck list shows a card under, by its front face's types before the dash: the first of these
    that is one of its words, so that an artifact land is a land; ``misc`` if there is none."""
    front = F.lower(F.split(F.split(type_line, " // ")[0], "—")[0])
    words = F.split(front, r"\s+")
    out = None
    for kind in ("creature", "land", "planeswalker", "battle", "instant", "sorcery", "artifact", "enchantment"):
        out = F.when(F.array_contains(words, kind), kind) if out is None else out.when(F.array_contains(words, kind), kind)
    return out.otherwise("misc")


#: Layouts of cards with two or more faces, and those that no constructed deck lists.
SEVERAL_FACES = ("adventure", "double_faced_token", "flip", "modal_dfc", "reversible_card", "split", "transform")
NOT_PLAYABLE = ("art_series", "double_faced_token", "emblem", "front_card", "planar", "scheme", "token", "vanguard")


def resolvable(alias_rows: DataFrame, cards: DataFrame) -> DataFrame:
    """Aliases of cards that decks can list."""
    return alias_rows.join(cards.where(F.col("layout").isin(*NOT_PLAYABLE)).select("card_id"), "card_id", "left_anti")


def merged(rows: DataFrame, key: str, *columns: Column) -> DataFrame:
    """Each id once, with all columns or those given; rows identical in all columns are one, different ones under one id an
    error."""
    # hashes don't compress, so they move as bytes; any row will do where all are the same
    content = F.unhex(F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != key])), 256))
    each = rows.groupBy(key).agg(F.first(F.struct(*(columns or rows.columns))).alias("r"), F.min(content).alias("first"), F.max(content).alias("last"))
    wrong = F.raise_error(F.concat(F.lit("conflicting rows of "), F.col(key).cast("string"))).cast("string")
    return each.withColumn("ok", F.when(F.col("first") != F.col("last"), wrong)).where("ok IS NULL").select("r.*")


def projected(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw card objects to kept rows (with colours from the faces where the card has none of its own) and
    counts of rejected ones by reason."""
    reason = F.when(F.coalesce("oracle_id", F.lit("")) == "", "missing_oracle_id").when(F.col("layout").isin(*SEVERAL_FACES) & (F.coalesce(F.size("card_faces"), F.lit(0)) < 2), "missing_required_faces")
    judged = raw.withColumn("reason", reason)
    known = F.forall("card_faces", lambda f: f["colors"].isNotNull())
    union = F.filter(F.array(*map(F.lit, "WUBRG")), lambda c: F.exists("card_faces", lambda f: F.array_contains(f["colors"], c)))
    kept = judged.where("reason IS NULL").drop("reason").withColumn("colors", F.coalesce("colors", F.when(known & (F.size("card_faces") > 0), union)))
    return kept, judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("cards"))


@dataclass(frozen=True)
class Catalogue:
    """``cards`` by their representative version, its ``faces`` in order, ``printings`` with their pictures, ``aliases``
    (alias_key, kind) of cards, and how many source rows were ``excluded`` for which reason."""

    cards: DataFrame
    faces: DataFrame
    printings: DataFrame
    aliases: DataFrame
    excluded: DataFrame


def catalogue(raw: DataFrame) -> Catalogue:
    """The whole projection of raw card objects.  A printing that comes twice is one if the objects are the same, and an
    error if not.  A card is described by its English, newest, least printing; printings meet their card in one
    aggregate that keeps a single version a task, so a card of very many printings is no hot key.  Printings move without
    the texts that are their card's, so the raw objects are read twice: for printings and for cards."""
    kept, excluded = projected(raw)
    printings = cut(merged(
        kept, "id",
        F.col("id").alias("printing_id"), F.col("oracle_id").alias("card_id"), F.col("set").alias("set_code"), F.col("set_name"), F.col("collector_number"), F.col("rarity"), F.to_date("released_at").alias("released_on"), F.col("lang").alias("language"), F.array_sort("games").alias("games"),
        F.array_sort(pictured()).alias("images"),
    ))
    day = F.coalesce(F.datediff(F.lit("1970-01-01").cast("date"), F.to_date("released_at")), F.lit(2**31 - 1))
    version = F.struct("id", "name", "layout", "cmc", "mana_cost", "type_line", "oracle_text", "colors", "color_identity", "card_faces")
    best = cut(kept.groupBy("oracle_id").agg(F.min_by(version, F.struct((F.col("lang") != "en").alias("a"), day.alias("b"), F.col("id").alias("c"))).alias("v")).select(F.col("oracle_id").alias("card_id"), "v.*"))
    key = lambda c: ascii_name_key(c)
    cards = best.select("card_id", F.col("id").alias("source_id"), "name", key(F.col("name")).alias("name_key"), "layout", F.col("cmc").alias("mana_value"), "mana_cost", "type_line", "oracle_text", "colors", "color_identity")
    faces = best.select("card_id", F.posexplode("card_faces").alias("face_index", "f")).select("card_id", "face_index", *[F.col(f"f.{c}").alias(c) for c in ("name", "mana_cost", "type_line", "oracle_text", "colors")])
    own = cards.select("card_id", F.col("name_key").alias("alias_key"), F.lit("canonical").alias("kind"))
    names = own.unionByName(faces.select("card_id", key(F.col("name")).alias("alias_key"), F.lit("face").alias("kind"))).distinct()
    return Catalogue(cards, faces, printings, names, excluded)


def conflicts(rows: DataFrame, key: str) -> DataFrame:
    """Ids under which different rows stand; identical ones are one."""
    content = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    return rows.select(key, F.sha2(content, 256).alias("h")).groupBy(key).agg(F.countDistinct("h").alias("versions")).where("versions > 1")


def printing_page(printings: DataFrame, card_id: int, after: int | None, limit: int, fits: Column | None = None) -> DataFrame:
    """A card's printings (those that are ``asked`` for, if that is given) in the order of originals, after the one of the
    last id, with one row more to tell whether another page follows: the whole key of the last id is looked up and
    compared, so no row is numbered."""
    own = with_original_key(printings.where(F.col("card_id") == card_id))
    if fits is not None:
        own = own.where(fits)
    if after is not None:  # one row
        own = own.join(F.broadcast(own.where(F.col("printing_id") == after).select(F.col("original").alias("last"))), F.col("original") > F.col("last")).drop("last")
    return own.orderBy("original").limit(limit + 1).drop("original")


def pictured() -> Column:
    """A row's pictures (face_index, source_uri, artist): the whole card's (NULL index), then its faces' in order; only those
    of normal size."""
    own = F.array(F.struct(F.lit(None).cast("int").alias("face_index"), F.col("image_uris")["normal"].alias("source_uri"), F.col("artist").alias("artist")))
    faces = F.transform("card_faces", lambda f, i: F.struct(i.alias("face_index"), f["image_uris"]["normal"].alias("source_uri"), f["artist"].alias("artist")))
    return F.filter(F.concat(own, F.coalesce(faces, F.slice(own, 1, 0))), lambda x: x["source_uri"].isNotNull())


def images(raw: DataFrame) -> DataFrame:
    """(id, face_index, source_uri, artist) of every picture."""
    return raw.select("id", F.explode(pictured()).alias("x")).select("id", "x.*")


def shown(raw: DataFrame) -> DataFrame:
    """(id, mana_cost, type_line): the card's own, else the first face's cost and all faces' types."""
    types = F.array_join(F.transform("card_faces", lambda f: f["type_line"]), " // ")
    return raw.select("id", F.coalesce("mana_cost", F.try_element_at("card_faces", F.lit(1))["mana_cost"]).alias("mana_cost"), F.coalesce("type_line", types).alias("type_line"))
