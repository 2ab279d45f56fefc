"""Readers of retained snapshots: card files, tournament responses, saved pages.  Schemas are given, never
inferred, and what a manifest says of a file is checked before its rows are used."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import COUNTRY, decode_page, halves_apart, html_text, html_texts, mended, unligatured
from ..operators.ingest import count_or_null, uuid_or_null

FACE = "struct<name:string,mana_cost:string,type_line:string,oracle_text:string,colors:array<string>,image_uris:map<string,string>,artist:string>"
CARD = f"""id string, oracle_id string, name string, layout string, lang string, released_at string, set string, set_name string, set_type string, collector_number string, rarity string, games array<string>,
digital boolean, oversized boolean, border_color string, prices map<string,string>, mana_cost string, cmc double, type_line string, oracle_text string, colors array<string>, color_identity array<string>,
image_uris map<string,string>, artist string, card_faces array<{FACE}>"""
RESPONSE = """TID string, tournamentName string, swissNum int, startDate bigint, game string, format string, topCut string, isTeamEvent boolean,
standings array<struct<decklist:string,deckObj:string,wins:int,losses:int,draws:int,byes:int,winsBracket:int,lossesBracket:int,archetype:string>>"""


def cards(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Card objects from JSON lines or from one JSON array; a gzip file needs the extension ``.gz``.  Blank
    lines and rows that are no objects give rows without an id, and go."""
    rows = spark.read.schema(CARD).option("multiLine", not lines).json(path)
    return rows.where("id IS NOT NULL")


def verified(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """The files of a folder (file, content) that a manifest (file, sha256) names; one that is missing or
    differs raises."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    digest = F.sha2("content", 256)
    wrong = F.raise_error(F.concat(F.lit("missing or changed: "), "file"))
    return manifest.join(files, "file", "left").withColumn("content", F.when(digest.eqNullSafe(F.col("sha256")), F.col("content")).otherwise(wrong.cast("binary")))


def sniffed(files: DataFrame) -> DataFrame:
    """(file, content) to (file, text): one row for a file that begins with ``[``, else one for every line that
    isn't blank.  Gzip is told by the first two bytes, whatever the file is called, and lines are read as a stream."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["file"], frame["content"], strict=True):
                raw = io.BytesIO(content)
                stream = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw, "utf-8")
                lines = (line for line in stream if line.strip())
                first = next(lines, "")
                if first.lstrip().startswith("["):
                    yield pd.DataFrame({"file": [file], "text": [first + stream.read()]})
                    continue
                lines = chain([first] if first else [], lines)
                while held := list(islice(lines, 2_000)):
                    yield pd.DataFrame({"file": file, "text": held})

    return files.select("file", "content").mapInPandas(read, "file string, text string")


def verified_cards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Card objects of the files that a manifest (file, sha256) names, out of the very bytes that were checked;
    arrays and JSON lines, packed or not.  What is no object goes."""
    card = T.StructType.fromDDL(CARD)
    text = sniffed(verified(spark, path, manifest))
    array = F.ltrim("text").startswith("[")
    one = F.when(array, F.from_json("text", T.ArrayType(card))).otherwise(F.array(F.from_json("text", card)))
    return text.select(F.explode(one).alias("card")).select("card.*").where("id IS NOT NULL")


def retrieval(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of files (file, retrieved_at: when each was last written) with the time that the manifest (file,
    retrieved_at) has for theirs, if any, and which of the two it is."""
    told = manifest.select("file", F.col("retrieved_at").alias("told"))
    out = rows.join(told, "file", "left").withColumn("retrieved_at_basis", F.when(F.col("told").isNotNull(), "manifest").otherwise("file_mtime"))
    return out.withColumn("retrieved_at", F.coalesce("told", "retrieved_at")).drop("told")


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Events of saved responses, with their file and when it was saved; team events go.  ``deckObj`` stays JSON, as
    its metadata entry isn't of the zones' form."""
    rows = spark.read.schema(RESPONSE).option("multiLine", True).json(path)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("TID").alias("event_id"), F.to_date(F.timestamp_seconds("startDate")).alias("occurred_on"), "game", "format", F.col("topCut").alias("cut_text"), "isTeamEvent", "standings", F.col("_metadata.file_modification_time").alias("retrieved_at")).where(
        "event_id IS NOT NULL AND NOT coalesce(isTeamEvent, false)"
    )


def deck_lines(events: DataFrame) -> DataFrame:
    """(event_id, position, zone, name, card_id, copies): the entries of all zones; entries without a usable id
    or with no positive count have NULL there, to be counted as skipped."""
    rows = events.select("event_id", F.posexplode("standings").alias("position", "row")).where("row.deckObj IS NOT NULL")
    one = T.MapType(T.StringType(), T.StructType([T.StructField("id", T.StringType()), T.StructField("count", T.IntegerType())]))
    out = None
    for zone in ("Mainboard", "Sideboard", "Commanders", "Commander"):  # by name: the metadata entry is no zone
        part = rows.select("event_id", "position", F.lit(zone).alias("zone"), F.explode(F.from_json(F.get_json_object("row.deckObj", f"$.{zone}"), one)).alias("name", "v"))
        out = part if out is None else out.unionByName(part)
    count = count_or_null(F.col("v.count"))
    return out.select("event_id", "position", "zone", "name", uuid_or_null(F.col("v.id")).alias("card_id"), F.when(count > 0, count).alias("copies"))


#: The zones of a deck object, and those of them that hold commanders, whatever their letters' case.
MAINBOARD, SIDEBOARD, COMMANDER_ZONES = "Mainboard", "Sideboard", ("commander", "commanders")


def variant_lines(events: DataFrame) -> DataFrame:
    """(event_id, position, label, zone, name, card_id, copies) of every deck object, read as a VARIANT, so that entries may be
    of any form: an entry without a usable id, or whose count is no whole number above zero, has NULL there.  Zones that
    hold nothing, and what is no zone, give no rows; a deck object that is no JSON is none."""
    rows = events.select("event_id", F.posexplode("standings").alias("position", "row")).select("event_id", "position", F.nullif(F.trim("row.archetype"), F.lit("")).alias("label"), F.try_parse_json("row.deckObj").alias("deck"))
    spark = events.sparkSession
    exploded = spark.sql(
        """SELECT event_id, position, label, z.key AS zone, l.key AS name, l.value AS line
           FROM {rows}, LATERAL variant_explode(deck) z, LATERAL variant_explode(z.value) l WHERE l.key IS NOT NULL""",
        rows=rows.where("schema_of_variant(deck) LIKE 'OBJECT%'"),
    )
    kind = F.when(F.col("zone") == MAINBOARD, "main").when(F.col("zone") == SIDEBOARD, "side").when(F.lower("zone").isin(*COMMANDER_ZONES), "commander")
    whole = F.schema_of_variant(F.try_variant_get("line", "$.count", "variant")).isin("BIGINT")
    count = F.when(whole, F.try_variant_get("line", "$.count", "long"))
    lines = exploded.select("event_id", "position", "label", kind.alias("zone"), "name", uuid_or_null(F.try_variant_get("line", "$.id", "string")).alias("card_id"), F.when(count > 0, count).alias("copies"))
    return lines.where("zone IS NOT NULL")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of saved pages in UTF-8 or the Western code page."""
    decode = F.pandas_udf(lambda s: s.map(lambda b: decode_page(bytes(b))), "string")
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), decode("content").alias("text"))


def table_rows(page_text: DataFrame) -> DataFrame:
    """(file, row_ord, cells) of every table row of pages: the shape of results, standings and listings."""
    rows = page_text.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)).alias("row_ord", "row"))
    # a row's cells stay together, so no row moves
    cells = rows.select("file", "row_ord", F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1).alias("cells"))
    return html_texts(cells.where(F.size("cells") > 0), "cells")


#: How results are written, and a bye instead of an opponent.
OUTCOME, BYE = r"(?i)^(won|lost|drew)\s+\d+-\d+(?:-\d+)?$", r"(?i)\bbye\b"


def results(rows: DataFrame) -> DataFrame:
    """(file, row_ord, player, opponent, result) from numbered rows: table, ``Last, First [XX]``, ``Won 2-0``, ``vs.``,
    opponent.  A row that names a bye anywhere behind the player is a ``bye``, whatever it says was won; one that is
    neither that nor a match is ``unread``."""
    c = F.col("cells")
    opponent = F.coalesce(F.try_element_at(c, F.lit(5)), F.lit(""))
    bye = F.exists(F.slice(c, 3, F.greatest(F.size(c) - 2, F.lit(0))), lambda x: x.rlike(BYE))
    match = F.try_element_at(c, F.lit(3)).rlike(OUTCOME) & (opponent != "")
    result = F.when(bye, "bye").when(match, F.lower(F.regexp_extract(c[2], OUTCOME, 1))).otherwise("unread")
    numbered = rows.where((F.size(c) >= 3) & c[0].rlike(r"^\d+$"))
    return numbered.select("file", "row_ord", c[1].alias("player"), F.when(~bye & match, opponent).alias("opponent"), result.alias("result"))


#: Shapes of page names: halves of the field by initials, decks of the best records, the last eight.
FIELD = r"^(?:(?:all)?decks([a-z])([a-z])|([a-z])([a-z])decks)$"
BEST_RECORDS, LAST_EIGHT = r"^(?:tedecks|(?:f-)?top(?:std|ext|block)\w*)$", r"^(?:t8|top8)(?:decks|decklists|bcd)$"


def deck_pages(pages_of: DataFrame) -> DataFrame:
    """(event_id, slug) to the pages that list the field's decks (event_id, slug, place): pages by initials, or if
    there are none every page of decks but those of techniques, samples and the last eight; then the best records,
    then the last eight."""
    slug = F.col("slug")
    low, high = F.greatest(F.regexp_extract(slug, FIELD, 1), F.regexp_extract(slug, FIELD, 3)), F.greatest(F.regexp_extract(slug, FIELD, 2), F.regexp_extract(slug, FIELD, 4))
    initials = slug.rlike(FIELD) & (low <= high)
    other = slug.contains("deck") & ~slug.rlike("tech|sample") & ~slug.rlike("^(?:t8|top8)")
    rows = pages_of.select("event_id", "slug").distinct().withColumn("initials", initials)
    rows = rows.withColumn("split", F.max("initials").over(Window.partitionBy("event_id")))
    part = F.when(F.when(F.col("split"), F.col("initials")).otherwise(other), 0).when(slug.rlike(BEST_RECORDS), 1).when(slug.rlike(LAST_EIGHT), 2)
    chosen = rows.withColumn("part", part).where("part IS NOT NULL")
    return chosen.select("event_id", "slug", F.row_number().over(Window.partitionBy("event_id").orderBy("part", "slug")).alias("place"))


def result_round(slug: F.Column) -> F.Column:
    """The round that a page of results reports (``res3`` and ``res3a``: 3), or NULL."""
    return F.when(slug.rlike(r"^res(\d+)[a-z]?$"), F.regexp_extract(slug, r"^res(\d+)", 1).cast("int"))


#: How pages of decks mark a deck (either layout), its side, what is no card, and a caption that names
#: the event only.
DECK, OLD_DECK = '<div class="deck">', r'(?s)<font size="\+1">(.*?)</font>\s*</b>\s*<br\s*/?>(.*?)</p>'
SIDE = r'(?i)<[^<>]*class="decktitle">(?:\s|<[^>]+>)*Sideboard'
NO_CARDS = r'(?s)<span class="decktotals">.*?</span>|<p class="cardcount">.*?</p>'
EVENT_CAPTION, NAME_FROM_DECK = r"(?i)pro\s*tour", r"\s*[–—]\s*|\s+-\s+"


def page_lists(page_text: DataFrame) -> DataFrame:
    """(file, deck, player, label, cards) of every deck of pages (file, text), its cards (zone, name, copies) each once.  A
    label is the deck's caption, or what follows the player's name; captions that name the event are none.  From the title
    of the side on, and in shaded columns, cards are the side's.  Decks without a main part go.  A deck is one row all the
    way, so nothing moves."""
    new = F.col("text").contains(DECK)
    parts = F.when(new, F.split("text", DECK)).otherwise(F.split("text", "(?=" + OLD_DECK + ")"))
    # the parts are made before they are dealt out, so that no deck carries its page's text
    blocks = page_text.select("file", new.alias("new"), parts.alias("parts")).select("file", "new", F.posexplode("parts").alias("deck", "block"))
    head = F.when(F.col("new"), F.regexp_extract("block", r"(?s)<heading>(.*?)</heading>", 1)).otherwise(F.regexp_extract("block", OLD_DECK, 1))
    caption = F.when(F.col("new"), F.regexp_extract("block", r'(?s)<div class="sub">(.*?)</div>', 1)).otherwise(F.regexp_extract("block", OLD_DECK, 2))
    # what stands before a page's first deck is none in the new layout, and has no header in the old one
    decks = blocks.withColumns({"head": head, "caption": caption}).where("head <> '' AND (deck > 0 OR NOT new)")
    # the side's title may stand within a column, the rest of which is then a column of the side
    body = F.split(F.regexp_replace("block", NO_CARDS, ""), SIDE, 2)
    halves = F.transform(body, lambda x, i: F.struct(F.when(i == 0, "main").otherwise("side").alias("zone"), F.when(i == 0, x).otherwise(F.concat(F.lit('<td valign="top">'), x)).alias("body")))
    column = F.lit(r'(?s)<td[^>]*valign="top"[^>]*>.*?(?:</td>|$)')
    shaded = lambda x: F.regexp_extract(x, r"^<td[^>]*>", 0).contains("statback")
    columns = F.flatten(F.transform(halves, lambda half: F.transform(F.regexp_extract_all(half["body"], column, F.lit(0)), lambda x: F.struct(F.when(shaded(x), "side").otherwise(half["zone"]).alias("zone"), x.alias("body")))))
    lines = F.flatten(F.transform("columns", lambda x: F.transform(F.split(x["body"], r"<br\s*/?>"), lambda line: F.struct(x["zone"].alias("zone"), line.alias("line")))))
    rows = decks.select("file", "deck", "head", "caption", columns.alias("columns")).select("file", "deck", "head", "caption", lines.alias("lines"))
    rows = html_texts(rows.select("file", "deck", "head", "caption", F.col("lines.zone").alias("zone"), F.col("lines.line").alias("line")), "line")
    told = F.filter(F.arrays_zip("zone", "line"), lambda x: x["line"].rlike(r"^\d+\s+\S"))
    # a step for each thing that the next uses more than once
    read = lambda x: F.struct(x["zone"].alias("zone"), F.regexp_extract(x["line"], r"^\d+\s+(.+)$", 1).alias("name"), F.regexp_extract(x["line"], r"^(\d+)", 1).try_cast("int").cast("long").alias("copies"))
    renamed = lambda step: lambda x: F.struct(x["zone"].alias("zone"), step(x["name"]).alias("name"), x["copies"].alias("copies"))
    cards = F.filter(F.transform(told, read), lambda x: x["copies"] > 0)
    for step in (unligatured, halves_apart, mended):
        cards = F.transform(cards, renamed(step))
    # chosen by a generator, as a filter would read all lines a second time
    main = F.filter(F.array(cards), lambda found: F.exists(found, lambda x: x["zone"] == "main"))
    rows = rows.select("file", "deck", "head", "caption", F.explode(main).alias("cards"))
    # a card that stands twice in a zone is one
    each = F.array_distinct(F.transform("cards", lambda x: F.struct(x["zone"].alias("zone"), x["name"].alias("name"))))
    copies = lambda k: F.aggregate(F.filter("cards", lambda x: (x["zone"] == k["zone"]) & (x["name"] == k["name"])), F.lit(0).cast("long"), lambda n, x: n + x["copies"])
    summed = F.transform(each, lambda k: F.struct(k["zone"].alias("zone"), k["name"].alias("name"), copies(k).alias("copies")))
    alone = F.size(F.array_distinct(F.transform("cards", lambda x: F.concat_ws(" ", x["zone"], x["name"])))) == F.size("cards")
    rows = rows.withColumn("cards", F.when(alone, F.col("cards")).otherwise(summed))
    rows = rows.withColumns({"head": html_text(F.col("head")), "caption": html_text(F.col("caption"))})
    named = F.split("head", NAME_FROM_DECK, 2)
    label = F.when(F.col("caption") != "", F.col("caption")).when(F.size(named) > 1, named[1])
    label = F.when((label != "") & ~label.rlike(EVENT_CAPTION), label)
    return rows.select("file", "deck", named[0].alias("player"), label.alias("label"), "cards")


def page_decks(page_text: DataFrame) -> DataFrame:
    """(file, deck, player, label, zone, name, copies): the cards of :func:`page_lists`, a row each."""
    return page_lists(page_text).select("file", "deck", "player", "label", F.explode("cards").alias("card")).select("file", "deck", "player", "label", "card.*")


def standings_rows(rows: DataFrame) -> DataFrame:
    """(file, place, player) from rows of a number and a name with a country."""
    c = F.col("cells")
    return rows.where((F.size(c) >= 2) & c[0].rlike(r"^\d+$") & c[1].rlike(COUNTRY)).select("file", c[0].cast("int").alias("place"), c[1].alias("player"))


def list_lines(texts: DataFrame) -> DataFrame:
    """(deck_id, text) to (deck_id, zone, name, copies): lines ``4 Name``; from a line ``Sideboard`` on, or lines
    marked ``SB:``, the side."""
    lines = texts.select("deck_id", F.posexplode(F.split("text", r"\R")).alias("ord", "line"))
    begun = F.max(F.lower(F.trim("line")).rlike("^sideboard:?$").cast("int")).over(Window.partitionBy("deck_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) == 1
    shape = r"^\s*(SB:\s*)?(\d{1,3})x?\s+(.+?)\s*$"
    rows = lines.withColumn("side", begun | F.col("line").rlike(r"^\s*SB:")).where(F.col("line").rlike(shape))
    return rows.select("deck_id", F.when(F.col("side"), "side").otherwise("main").alias("zone"), F.regexp_extract("line", shape, 3).alias("name"), F.regexp_extract("line", shape, 2).cast("int").alias("copies"))
