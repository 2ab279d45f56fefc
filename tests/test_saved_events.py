"""Saved events from folders with manifests to facts, in both layouts of pages."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from deckwright.operators import assembly, players
from deckwright.sources import files, saved_events

row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
deck = lambda who, label, main, side: f'<div class="deck"><heading>{who}</heading><div class="sub">{label}</div><td valign="top">{"<br>".join(main)}</td><td valign="top"><p class="decktitle">Sideboard</p>{"<br>".join(side)}</td></div>'
NAMES = ["Alpha, Ana [USA]", "Bravo, Ben [FRA]", "Carlo, Cy [ITA]", "Oodan, Takeshi [JPN]", "Echo, Eva [DEU]", "Fox, Flo [GBR]", "Golf, Gus [ESP]", "Hotel, Hana [ITA]", "India, Ida [NLD]"]
PAGES = {
    "afdecks": deck("Ana Alpha", "Burn", ["4 Bolt", "20 Mountain"], ["3 Duress"]) + deck("Ben Bravo", "Pro Tour-Here", ["4 Bolt", "2 Nosuch"], []) + deck("Cy Carlo", "", ["1 Fire/Ice"], ["1 Nosuch"]),
    "gzdecks": deck("Takeshi Odan", "Control", ["4 Island"], ["1 Bolt"]) + deck("Nobody Here", "", ["1 Island"], []),
    "top8decks": deck("Alpha, Ana", "Again", ["1 Island"], []) + deck("Hana Hotel", "Late", ["2 Island"], []),
    "res1": row(1, NAMES[0], "Won 2-0", "vs.", NAMES[1]) + row(1, NAMES[1], "Lost 0-2", "vs.", NAMES[0]) + row(2, "Oodan, Takeshi [USA]", "Drew 1-1-1", "vs.", NAMES[2]) + row(3, NAMES[8], "Won 2-0", "vs.", "* BYE *"),
    "res2": row(1, "wrong", "page", "of", "round"),
    "res2a": row(1, NAMES[0], "Drew 1-1", "vs.", NAMES[3]) + row(2, NAMES[1], "Won 2-1", "vs.", "Juliet, Jo [USA]") + row(3, NAMES[7], "Bye"),
    "res4": row(1, NAMES[0], "Lost 0-2", "vs.", NAMES[1]),
    "standfin": "".join(row(i + 1, n, 9 - i) for i, n in enumerate(NAMES)) + row(10, "Not a player"),
}
ALIASES = [("c1", "bolt", "canonical"), ("c2", "mountain", "canonical"), ("c3", "island", "canonical"), ("c4", "fire // ice", "canonical"), ("c5", "duress", "canonical")]


def save(folder, pages, event, **more):
    folder.mkdir(parents=True)
    requests = []
    for slug, text in pages.items():
        raw = text.encode("cp1252")
        (folder / f"page-{slug}.html").write_bytes(raw)
        requests.append({"raw_file": f"page-{slug}.html", "sha256": hashlib.sha256(raw).hexdigest(), "retrieved_at": "2026-10-20T04:48:00+00:00"})
    (folder / "manifest.json").write_text(json.dumps({"requests": requests, **({"event": event} if event else {}), **more}))
    return folder


@pytest.fixture(scope="module")
def read(spark):
    spark.dataSource.register(saved_events.SavedEvents)
    return lambda path: spark.read.format("saved_events").load(str(path))


EVENT = {"code": "coverage/first", "format": "Extended", "date": "2005-10-28", "constructed_rounds": [1, 2]}


@pytest.fixture(scope="module")
def facts(spark, read, tmp_path_factory):
    top = tmp_path_factory.mktemp("saved")
    save(top / "a", PAGES, EVENT)
    # no standings, a round missing, no list of rounds, the event in the summary
    save(top / "b", {k: PAGES[k] for k in ("gzdecks", "res1", "res4")}, None)
    (top / "b" / "summary.json").write_text(json.dumps({"event": {"code": "second", "format": "Standard", "date": "2006-01-02"}}))
    save(top / "c", {"about": "<p>nothing</p>"}, {"code": "third", "format": "Standard", "date": "2006-02-03"})
    (top / "not-an-event").mkdir()
    pages = read(top).cache()
    aliases = spark.createDataFrame(ALIASES, "card_id string, alias_key string, kind string")
    return pages, assembly.assemble(saved_events.once(pages), aliases)


def test_events_and_their_coverage(facts):
    pages, found = facts
    assert pages.rdd.getNumPartitions() >= 1 and {r.event_id for r in pages.collect()} == {"first", "second", "third"}
    assert {(r.retrieved_at_basis, r.retrieved_at) for r in pages.collect()} == {("manifest", dt.datetime(2026, 10, 20, 4, 48))}
    got = {r.event_id: (r.format, r.players, r.decklists, r.cut_size, r.cut_basis, r.decklist_coverage, r.standings_coverage, r.match_coverage, r.rounds_complete) for r in found.events.collect()}
    assert got == {
        "first": ("Extended", 10, 6, 8, "standing_order", "PARTIAL", "PARTIAL", "FULL_FIELD", True),
        "second": ("Standard", 5, 2, None, "unknown_top_cut", "PARTIAL", "NONE", "PARTIAL", False),
        "third": ("Standard", None, 0, None, "unknown_top_cut", "UNKNOWN", "UNKNOWN", "NONE", False),
    }


def test_decks_in_order_with_what_stayed_unresolved(facts):
    _, found = facts
    rows = sorted((r.event_id, r.number, r.player, r.label, r.skipped_main, r.skipped_side, r.complete, r.sideboard_observed) for r in found.decks.where("event_id = 'first'").collect())
    assert [r[1:] for r in rows] == [
        (1, "Ana Alpha", "Burn", 0, 0, True, True), (2, "Ben Bravo", None, 1, 0, False, False), (3, "Cy Carlo", None, 0, 1, True, False), (4, "Takeshi Odan", "Control", 0, 0, True, True),
        (5, "Nobody Here", None, 0, 0, True, False), (6, "Hana Hotel", "Late", 0, 0, True, False),
    ]
    cards = {(r.number, r.card_id): (r.main, r.side) for r in found.cards.where("event_id = 'first'").collect()}
    assert cards == {(1, "c1"): (4, 0), (1, "c2"): (20, 0), (1, "c5"): (0, 3), (2, "c1"): (4, 0), (3, "c4"): (1, 0), (4, "c3"): (4, 0), (4, "c1"): (0, 1), (5, "c3"): (1, 0), (6, "c3"): (2, 0)}
    assert [r.name for r in found.unresolved.collect()] == ["Nosuch"]


def test_standings_have_rank_record_byes_and_cut(facts):
    _, found = facts
    got = {(r.event_id, r.number): (r.player, r.final_rank, r.wins, r.losses, r.draws, r.byes, r.made_cut) for r in found.standings.collect()}
    assert got == {
        ("first", 1): (NAMES[0], 1, 1, 0, 1, 0, True), ("first", 2): (NAMES[1], 2, 1, 1, 0, 0, True), ("first", 3): (NAMES[2], 3, 0, 0, 1, 0, True),
        ("first", 4): (NAMES[3], 4, 0, 0, 2, 0, True), ("first", 6): (NAMES[7], 8, 0, 0, 0, 1, True), ("second", 1): ("Oodan, Takeshi [USA]", None, None, None, None, None, None),
    }
    assert {r.method: r.decks for r in assembly.join_methods(found).collect()} == {"exact": 4, "similar": 2, "unmatched": 2}


def test_identity_follows_contents_but_not_their_order(spark, facts):
    pages, _ = facts
    names = lambda df, *more: {r.event_id: r.identity for r in saved_events.identities(df, *more).collect()}
    own = names(pages, "v1")
    assert own == names(pages.orderBy(F.rand()), "v1") and len(set(own.values())) == 3
    assert all(own[k] != v for k, v in names(pages, "v2").items())
    changed = names(pages.withColumn("sha256", F.when(F.col("file") == "page-res4.html", "0").otherwise(F.col("sha256"))), "v1")
    assert {k for k in own if own[k] != changed[k]} == {"first", "second"}


def test_what_is_wrong_raises(read, tmp_path):
    folder = save(tmp_path / "x" / "a", PAGES, EVENT)
    assert read(folder).count() == len(PAGES)
    save(tmp_path / "x" / "b", {"res1": ""}, EVENT)
    with pytest.raises(Exception, match="saved more than once: first"):
        saved_events.once(read(tmp_path / "x")).collect()
    (folder / "page-res1.html").write_text("changed")
    with pytest.raises(Exception, match="SHA-256"):
        read(folder).collect()
    with pytest.raises(Exception, match="no saved pages"):
        read(save(tmp_path / "y", {}, EVENT)).collect()
    (tmp_path / "z").mkdir()
    with pytest.raises(Exception, match="no saved event"):
        read(tmp_path / "z").collect()


def test_rows_of_pages_stay_where_their_page_is(spark):
    """Nothing of a page is dealt out to be gathered again, a card that stands twice in a zone is one, and entities are resolved."""
    body = '<td valign="top">2 A&amp;B<br>1 Island</td><td valign="top">3  Island<br>0 None</td><td class="statback" valign="top">1 Island</td>'
    page = f'<div class="deck"><heading>Zo&euml; Q</heading><div class="sub"></div>{body}</div>' + row(1, "&Eacute;clair, Al [FRA]", "Won 2-0", "vs.", "B&amp;B, Cy [USA]") + "<tr></tr>"
    pages = spark.createDataFrame([("p", page), ("q", None)], "file string, text string")
    decks, rows = files.page_decks(pages), files.table_rows(pages)
    assert sorted(map(tuple, decks.collect())) == [("p", 1, "Zoë Q", None, "main", "A&B", 2), ("p", 1, "Zoë Q", None, "main", "Island", 4), ("p", 1, "Zoë Q", None, "side", "Island", 1)]
    assert [(r.row_ord, r.cells) for r in rows.collect()] == [(0, ["1", "Éclair, Al [FRA]", "Won 2-0", "vs.", "B&B, Cy [USA]"])]
    for plan in (x._jdf.queryExecution().optimizedPlan().toString() for x in (decks, rows)):
        assert not any(step in plan for step in ("Aggregate [", "Repartition", "Window", "Join")), plan


def test_later_passes_read_only_what_is_left(spark, monkeypatch):
    """Of two events' names, an exact match and a similar one; the second event has nobody left for later passes."""
    left = []

    def truncated(decks, standing, own=players.truncated):
        left.append(({r.deck for r in decks.collect()}, {r.player for r in standing.collect()}))
        return own(decks, standing)

    monkeypatch.setattr(players, "truncated", truncated)
    names = [("e", "deck", "Zoë Müller"), ("e", "deck", "Jon Smithe"), ("e", "standing", "Muller, Zoe [DEU]"), ("e", "standing", "Smith, Jon [USA]"), ("f", "deck", "Ana Alpha"), ("f", "standing", "Alpha, Ana [USA]"), ("f", "standing", "Bravo, Ben [USA]"), ("g", "deck", None)]
    got = players.match(spark.createDataFrame(names, "event_id string, side string, name string").withColumn("ord", F.lit(0))).collect()
    assert {tuple(r) for r in got} == {("e", "Zoë Müller", "Muller, Zoe [DEU]", 1), ("e", "Jon Smithe", "Smith, Jon [USA]", 2), ("f", "Ana Alpha", "Alpha, Ana [USA]", 1)}
    assert left == [({"Jon Smithe"}, {"Smith, Jon [USA]"})]
