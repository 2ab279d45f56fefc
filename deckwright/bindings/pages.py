"""Pages of saved events, written from the shared tables: up to 64 orders of neighbouring keys are an event's field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .tpch import Tables

FIELD = 64


def cell(x: Column) -> Column:
    return F.concat(F.lit("<td>"), x, F.lit("</td>"))


def rows(df: DataFrame, slug: Column, order: str, *cells: Column) -> DataFrame:
    """(event_id, slug, text): a table of one row each."""
    body = df.select("event_id", slug.alias("slug"), F.struct(F.col(order).alias("o"), F.concat(F.lit("<tr>"), *map(cell, cells), F.lit("</tr>")).alias("h")).alias("x"))
    return body.groupBy("event_id", "slug").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), "\n"), F.lit("</table>")).alias("text"))


def field(t: Tables) -> DataFrame:
    """(event, event_id, deck_id, place, n): an event's players in order, who finished so."""
    event = F.floor(F.col("o_orderkey") / FIELD)
    inner = Window.partitionBy("event")
    seats = t.raw("orders").select(event.alias("event"), F.col("o_orderkey").alias("deck_id"), F.col("o_orderpriority").alias("priority"))
    key = F.col("deck_id").cast("string")
    first, last = F.translate(F.reverse(key), "0123456789", "anbolirtes"), F.concat(F.lit("mc"), F.translate(key, "0123456789", "karemdosuv"))
    return seats.select(
        "event", F.concat(F.lit("e"), "event").alias("event_id"), "deck_id", "priority", F.row_number().over(inner.orderBy("deck_id")).alias("place"), F.count("*").over(inner).alias("n"),
        F.concat_ws(" ", first, last).alias("plain"), F.concat(last, F.lit(", "), first).alias("turned"),
    )


def saved(t: Tables) -> DataFrame:
    """Pages in the shape that the reader of saved events gives.  Every fourth event has no standings, every fifth lacks its
    second round, and some results name another country than the standings."""
    people = cut(field(t))  # read by every kind of page
    standings = rows(people.where("event % 4 <> 3"), F.lit("standfin"), "place", F.col("place").cast("string"), F.concat("turned", F.lit(" [XX]")))
    told = F.concat("turned", F.when(F.col("deck_id") % 7 == 0, F.lit(" [YY]")).otherwise(F.lit(" [XX]")))
    seats = people.select("event", "event_id", "deck_id", "place", told.alias("name"))
    # the first round pairs places 1 and 2, 3 and 4; the second 2 and 3, 4 and 5
    number = F.col("round")
    side = seats.withColumn("round", F.explode(F.array(F.lit(1), F.lit(2)))).withColumns({"game": F.floor((F.col("place") + (number - 1)) / 2 + 0.5), "seat": (F.col("place") + number) % 2})
    games = side.groupBy("event", "event_id", "round", "game").agg(*[F.max(F.when(F.col("seat") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("name", "deck_id")])
    score = F.element_at(F.array(F.lit("Won 2-0"), F.lit("Lost 1-2"), F.lit("Drew 1-1-1")), (F.col("deck_id0") % 3 + 1).cast("int"))
    alone = F.col("name0").isNull() | F.col("name1").isNull()
    results = rows(games.where("round = 1 OR event % 5 <> 0"), F.concat(F.lit("res"), F.col("round").cast("string")), "game", F.col("game").cast("string"), F.coalesce("name0", "name1"), F.when(alone, "Won 2-0").otherwise(score), F.lit("vs."), F.when(alone, "* BYE *").otherwise(F.col("name1")))
    # both zones by the rules of Tables.deck_cards and Tables.sideboards, from one pass over the lines
    back = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 3)
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("deck_id"), F.col("l_partkey").alias("card_id"), F.col("l_quantity").alias("q"), F.when(back, F.col("l_quantity")).alias("q1")).repartition("deck_id")
    lines = lines.groupBy("deck_id", "card_id").agg((F.min("q").cast("int") % 4 + 1).alias("n0"), (F.min("q1").cast("int") % 3 + 1).alias("n1"))
    line = lambda copies: F.concat(F.col(copies).cast("string"), F.lit(" Part "), F.col("card_id").cast("string"))
    zones = lines.groupBy("deck_id").agg(*[F.array_join(F.sort_array(F.collect_list(line(f"n{z}"))), "<br>").alias(f"z{z}") for z in (0, 1)])
    label = F.when(F.col("deck_id") % 6 == 0, "Pro Tour-Here").otherwise(F.col("priority"))

    def block(label: Column) -> Column:
        column = lambda body: F.concat(F.lit('<td valign="top">'), body, F.lit("</td>"))
        side = F.when(F.col("z1") != "", column(F.concat(F.lit('<p class="decktitle">Sideboard</p>'), "z1"))).otherwise("")
        return F.concat(F.lit('<div class="deck"><heading>'), "plain", F.lit('</heading><div class="sub">'), label, F.lit("</div>"), column(F.col("z0")), side, F.lit("</div>"))

    # the top eight's page lists the first deck again, under another name
    once = F.struct(F.when(F.col("place") % 2 == 1, "afdecks").otherwise("gzdecks").alias("slug"), label.alias("label"))
    again = F.struct(F.lit("top8decks").alias("slug"), F.lit("Again").alias("label"))
    listed = people.join(zones, "deck_id").withColumn("on", F.explode(F.when(F.col("place") == 1, F.array(once, again)).otherwise(F.array(once))))
    decks = listed.select("event_id", "place", F.col("on.slug").alias("slug"), block(F.col("on.label")).alias("h")).groupBy("event_id", "slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "\n").alias("text"))
    pages = standings.unionByName(results).unionByName(decks)
    return pages.select("event_id", F.lit("Extended").alias("format"), F.lit("2005-10-28").cast("date").alias("occurred_on"), F.array(F.lit(1), F.lit(2)).alias("rounds"), F.lit(0).alias("ord"), "slug", "text")


def aliases(t: Tables) -> DataFrame:
    """Names of nine parts in ten."""
    return t.raw("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("card_id"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("alias_key"), F.lit("canonical").alias("kind"))


#: The same facts by other ways, straight from the tables.
SQL = """
WITH people AS (
  SELECT o_orderkey // 64 AS event, o_orderkey AS deck_id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS label,
    row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderkey // 64) AS n FROM orders),
main AS (SELECT l_orderkey AS deck_id, l_partkey AS card_id FROM lineitem GROUP BY ALL),
side AS (SELECT l_orderkey AS deck_id, l_partkey AS card_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3 GROUP BY ALL),
zones AS (
  SELECT deck_id, (SELECT count(*) FROM main m WHERE m.deck_id = d.deck_id AND card_id % 10 = 0) AS skipped_main, (SELECT count(*) FROM side s WHERE s.deck_id = d.deck_id AND card_id % 10 = 0) AS skipped_side,
    (SELECT count(*) FROM side s WHERE s.deck_id = d.deck_id) AS sides FROM (SELECT DISTINCT deck_id FROM main) d),
games AS (
  SELECT p.event, r AS round, p.deck_id AS a, q.deck_id AS b FROM people p CROSS JOIN (VALUES (1), (2)) AS t(r) LEFT JOIN people q ON q.event = p.event AND q.place = p.place + 1
  WHERE p.place % 2 = r % 2 AND (r = 1 OR p.event % 5 <> 0)
  UNION ALL SELECT event, 2, deck_id, NULL FROM people WHERE place = 1 AND event % 5 <> 0),
seats AS (
  SELECT event, a AS deck_id, CASE WHEN b IS NULL THEN 'bye' ELSE ['won', 'lost', 'drew'][a % 3 + 1] END AS r FROM games
  UNION ALL SELECT event, b, ['lost', 'won', 'drew'][a % 3 + 1] FROM games WHERE b IS NOT NULL),
record AS (SELECT deck_id, count(*) FILTER (r = 'won') AS wins, count(*) FILTER (r = 'lost') AS losses, count(*) FILTER (r = 'drew') AS draws, count(*) FILTER (r = 'bye') AS byes FROM seats GROUP BY deck_id),
roster AS (SELECT p.event, p.deck_id, CASE WHEN p.event % 4 <> 3 THEN place END AS final_rank FROM people p WHERE p.event % 4 <> 3 OR p.deck_id IN (SELECT deck_id FROM seats)),
listed AS (SELECT p.*, skipped_main, skipped_side, sides, row_number() OVER (PARTITION BY event ORDER BY 1 - place % 2, place) AS number FROM people p JOIN zones USING (deck_id)),
field AS (SELECT event, count(*) AS players, count(final_rank) AS ranked, count(*) FILTER (final_rank <= 8) = 8 AS cut FROM roster GROUP BY event),
lists AS (SELECT event, count(*) AS decklists FROM listed GROUP BY event)
SELECT 'e' || l.event AS event_id, l.number AS number, l.label, skipped_main, skipped_side, sides > 0 AND skipped_side = 0 AS sideboard_observed, players, decklists, CASE WHEN decklists < players THEN 'PARTIAL' ELSE 'FULL_FIELD' END AS decklist_coverage,
  CASE WHEN ranked = 0 THEN 'NONE' WHEN ranked < players THEN 'PARTIAL' ELSE 'FULL_FIELD' END AS standings_coverage, CASE WHEN l.event % 5 = 0 THEN 'PARTIAL' ELSE 'FULL_FIELD' END AS match_coverage,
  CAST(final_rank AS BIGINT) AS final_rank, CASE WHEN r.deck_id IS NOT NULL AND l.event % 5 <> 0 THEN coalesce(wins, 0) END AS wins, CASE WHEN r.deck_id IS NOT NULL AND l.event % 5 <> 0 THEN coalesce(losses, 0) END AS losses,
  CASE WHEN r.deck_id IS NOT NULL AND l.event % 5 <> 0 THEN coalesce(draws, 0) END AS draws, CASE WHEN r.deck_id IS NOT NULL AND l.event % 5 <> 0 THEN coalesce(byes, 0) END AS byes, CASE WHEN cut AND final_rank IS NOT NULL THEN final_rank <= 8 END AS made_cut
FROM listed l JOIN field USING (event) JOIN lists USING (event) LEFT JOIN roster r ON r.deck_id = l.deck_id LEFT JOIN record x ON x.deck_id = l.deck_id"""
