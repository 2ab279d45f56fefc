"""Operators on small tables whose results are worked out by hand."""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from deckwright.functions import stats, text
from deckwright.operators import catalog, cohort, ingest, players, publish, scoring, serving, usage, validate
from deckwright.sources import files


def test_midrank_shares_ties_and_leaves_nulls_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 5.0)], "k string, v double").withColumn("g", F.lit(1))
    got = {r.k: r.p for r in df.withColumn("p", stats.midrank(F.col("v"), "g")).collect()}
    assert got == {"a": 0.125, "b": 0.5, "c": 0.5, "d": None, "e": 0.875}


def test_blend_renormalises(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(stats.blend([(0.6, F.col("a")), (0.2, F.col("b"))])).collect()] == [1.0, None, pytest.approx(0.75)]


@pytest.fixture(scope="module")
def golden(spark):
    """Two events, nine players, eight decks, five cards, three archetypes."""
    rules = spark.createDataFrame([("f", dt.date(2026, 3, 1), dt.date(2026, 9, 1), 0.5, 2)], "format string, starts_on date, ends_before date, min_coverage double, players_per_game int")
    events = spark.createDataFrame([("open", dt.date(2026, 5, 10), "f", 6, 5), ("weekly", dt.date(2026, 8, 20), "f", 3, 3), ("early", dt.date(2026, 2, 28), "f", 4, 4), ("thin", dt.date(2026, 5, 1), "f", 9, 4), ("empty", dt.date(2026, 5, 1), "f", 0, 0), ("other", dt.date(2026, 5, 1), "g", 4, 4)], "event_id string, occurred_on date, format string, players int, decklists int")
    rows = [
        ("open", 5, 1, 0, True, {"Bolt": 4, "Ragavan": 4, "Mountain": 16}, "Burn"), ("open", 4, 2, 0, True, {"Rite": 4, "Bolt": 2, "Mountain": 16}, "Rite Combo"), ("open", 4, 2, 0, True, {"Snap": 4, "Bolt": 4, "Mountain": 16}, "Control"),
        ("open", 3, 3, 0, False, {"Bolt": 4, "Ragavan": 3, "Mountain": 16}, "Burn"), ("open", 2, 4, 0, False, {"Snap": 2, "Mountain": 16}, "Control"),
        ("weekly", 3, 0, 1, None, {"Rite": 4, "Mountain": 16}, "Rite Combo"), ("weekly", 2, 1, 1, None, {"Bolt": 4, "Ragavan": 4, "Mountain": 16}, "Burn"), ("weekly", 1, 3, 0, None, {"Snap": 4, "Bolt": 4, "Mountain": 16}, "Control"),
    ]
    decks = spark.createDataFrame([(i, r[0], r[6], i, True) for i, r in enumerate(rows)], "deck_id int, event_id string, label string, source_ord int, complete boolean")
    standings = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(rows)], "deck_id int, event_id string, wins int, losses int, draws int, made_cut boolean")
    cards = spark.createDataFrame([(i, c, n) for i, r in enumerate(rows) for c, n in r[5].items() if c != "Mountain"], "deck_id int, card_id string, copies int")
    none = spark.createDataFrame([], "event_id string, reason string")
    own = cohort.select(events, decks, standings, rules, none)
    judged = {r.event_id: r.reason for r in cohort.judged(events, rules, none).collect()}
    return own, usage.lines(own, cards), judged


def test_exclusion_reasons(golden):
    assert golden[2] == {"open": None, "weekly": None, "early": "window", "thin": "coverage low", "empty": "coverage unknown", "other": "format"}


def test_worked_example(golden):
    own, facts, _ = golden
    field = usage.field(own).first()
    assert (field.wins, field.losses, field.draws, field.cut_known, field.cut_made) == (24, 16, 2, 5, 3)
    assert usage.concentration(own.decks, "format").first().concentration == 0.25
    assert {r.period: r.decks for r in usage.series(own.decks, "format").collect()} == {4: 5, 11: 3}
    cards = {r.card_id: r for r in usage.card_usage(facts).collect()}
    assert {c: (r.deck_count, r.copies, r.playsets, r.cut_made, r.cut_known) for c, r in cards.items()} == {"Bolt": (6, 22, 5, 3, 4), "Ragavan": (3, 11, 2, 1, 2), "Rite": (2, 8, 2, 1, 1), "Snap": (3, 10, 2, 1, 2)}
    rows = scoring.features(own, facts).cache()
    got = {m: {r.card_id: round(r[2], 3) for r in scoring.run_method(m, rows).collect()} for m in scoring.METHODS}
    assert got["constructed"] == {"Bolt": 62.5, "Ragavan": 37.5, "Rite": 87.5, "Snap": 12.5}
    assert got["signature"] == {"Bolt": 12.5, "Ragavan": 87.5, "Rite": 37.5, "Snap": 62.5}
    assert got["hidden-gem"] == {"Bolt": 50.0, "Ragavan": 16.667, "Rite": 83.333, "Snap": 0.0}
    assert {c: round(x, 1) for c, x in got["max-ratio"].items()} == {"Bolt": 100.0, "Ragavan": 50.0, "Rite": 33.3, "Snap": 50.0}
    evidence = {r.card_id: round(r.evidence, 1) for r in scoring.run_method("foundation", rows).collect()}
    assert evidence == {"Bolt": 27.4, "Ragavan": 21.0, "Rite": 18.2, "Snap": 21.0}
    core = {(r.label, r.card_id) for r in usage.cores(facts).collect()}
    assert core == {("Burn", "Bolt"), ("Burn", "Ragavan"), ("Rite Combo", "Rite"), ("Rite Combo", "Bolt"), ("Control", "Snap"), ("Control", "Bolt")}


def test_overall(spark):
    rows = [("a", "x", 90.0, 1000), ("a", "y", 80.0, 250), ("a", "z", None, 50), ("b", "x", 50.0, 1000), ("c", "x", 10.0, 1000), ("c", "y", 0.0, 0)]
    got = {r.card_id: (r.formats, round(r.score, 3)) for r in scoring.overall(spark.createDataFrame(rows, "card_id string, format string, score double, decks long")).collect()}
    assert got == {"a": (2, 83.333), "b": (1, 50.0), "c": (1, 16.667)}


def test_cut_inference(spark):
    rows = [(e, i, w, bw, bl, s) for e, s, seats in (("bracket", 2, [(5, 1, 0), (4, 0, 1), (3, 0, 0)]), ("order", 1, [(5, None, None), (4, None, None)]), ("mixed", 1, [(1, None, None), (4, None, None)]), ("none", 0, [(1, None, None)]), ("unknown", None, [(1, None, None)]), ("hole", 1, [(None, None, None), (1, None, None)])) for i, (w, bw, bl) in enumerate(seats)]
    df = spark.createDataFrame(rows, "event_id string, position int, wins int, bracket_wins int, bracket_losses int, cut_size int")
    got = {(r.event_id, r.position): (r.basis, r.made_cut) for r in ingest.infer_cut(df).collect()}
    assert got[("bracket", 1)] == ("bracket_record", True) and got[("bracket", 2)] == ("bracket_record", False)
    assert got[("order", 0)] == ("standing_order", True) and got[("order", 1)] == ("standing_order", False)
    assert {k[0]: v for k, v in got.items() if v[1] is None} == {"mixed": ("inconsistent_order", None), "none": ("no_top_cut", None), "unknown": ("unknown_top_cut", None), "hole": ("inconsistent_order", None)}


def test_guards(spark):
    df = spark.createDataFrame([("8", -1), ("8-0", 3), (None, None)], "t string, n int")
    assert [tuple(r) for r in df.select(ingest.cut_size(F.col("t")), ingest.count_or_null(F.col("n"))).collect()] == [(8, None), (None, 3), (0, None)]


def test_duplicate_events(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "event_id string, n int")
    assert ingest.unique_events(rows).count() == 2
    with pytest.raises(Exception, match="conflicting event"):
        ingest.unique_events(rows.union(spark.createDataFrame([("b", 3)], rows.schema))).collect()


def test_names(spark):
    aliases = spark.createDataFrame([("1", "lim-dul", "canonical"), ("2", "fire", "face"), ("3", "fire", "canonical"), ("4", "twin", "face"), ("5", "twin", "face")], "card_id string, alias_key string, kind string")
    names = spark.createDataFrame([("Lim-Dûl",), (" FIRE ",), ("Twin",), ("lim dul",), ("nobody",)], "name string")
    got = {r.name: (r.card_id, r["pass"]) for r in ingest.resolve_names(names, aliases).collect()}
    assert got == {"Lim-Dûl": ("1", 2), " FIRE ": ("3", 1), "Twin": (None, None), "lim dul": ("1", 3), "nobody": (None, None)}


def test_players(spark):
    """Each case is an event of its own."""
    cases = {
        "many": (["Ana Alpha", "Benjamin Bravo Longname", "Dan Delta", "Takeshi Odan", "Bill Stark", "Nobody Here"], ["Alpha, Ana [USA]", "Bravo Long, Benjamin [FRA]", "Delta, D [DEU]", "Oodan, Takeshi [JPN]", "Stark, William [USA]"]),
        "given": (["Billy Moreno", "Tom Lapille", "Bryant Malig"], ["Moreno, William [USA]", "LaPille, Thomas [USA]", "Malig, J. Bryant [USA]", "Moreno, Ana [USA]"]),
        "tie": (["Kim Kilo"], ["Kilos, Kim [USA]", "Kilox, Kim [USA]"]),
        "alone": (["Ernesto Padilla"], ["Padilla Chinas, Jorge [MEX]"]),
        "crowded": (["Ernesto Padilla", "Jorge Padila"], ["Padilla Chinas, Jorge [MEX]"]),
        "first": (["Ana Alpha Smith", "Ana Alpha Jones"], ["Alpha, Ana [USA]"]),
        "suffix": (["Zo\u00eb de Rosa Jr."], ["DeRosa, Zoe [FRA]", ""]),
    }
    rows = [(e, side, n, i) for e, both in cases.items() for side, names in zip(("deck", "standing"), both, strict=True) for i, n in enumerate(names)]
    got = {(r.event_id, r.deck_name): (r.standing_name, players.PASSES[r["pass"] - 1]) for r in players.match(spark.createDataFrame(rows, "event_id string, side string, name string, ord int")).collect()}
    assert got == {
        ("many", "Ana Alpha"): ("Alpha, Ana [USA]", "exact"), ("many", "Benjamin Bravo Longname"): ("Bravo Long, Benjamin [FRA]", "truncated"), ("many", "Dan Delta"): ("Delta, D [DEU]", "truncated"),
        ("many", "Takeshi Odan"): ("Oodan, Takeshi [JPN]", "similar"), ("many", "Bill Stark"): ("Stark, William [USA]", "similar"),
        ("given", "Billy Moreno"): ("Moreno, William [USA]", "similar"), ("given", "Tom Lapille"): ("LaPille, Thomas [USA]", "surname_initial"), ("given", "Bryant Malig"): ("Malig, J. Bryant [USA]", "similar"),
        ("alone", "Ernesto Padilla"): ("Padilla Chinas, Jorge [MEX]", "similar"), ("crowded", "Jorge Padila"): ("Padilla Chinas, Jorge [MEX]", "similar"), ("first", "Ana Alpha Smith"): ("Alpha, Ana [USA]", "truncated"),
        ("suffix", "Zo\u00eb de Rosa Jr."): ("DeRosa, Zoe [FRA]", "truncated"),
    }


def test_short_surnames_meet(spark):
    rows = [("e", "deck", "Wei Li", 0), ("e", "standing", "Lai, Wei [SGP]", 0), ("f", "deck", "Ann Bo", 0), ("f", "standing", "Bo, Cy [USA]", 0), ("f", "standing", "Ob, Ann [USA]", 0)]
    got = {(r.deck_name, r.standing_name) for r in players.match(spark.createDataFrame(rows, "event_id string, side string, name string, ord int")).collect()}
    assert ("Wei Li", "Lai, Wei [SGP]") in got and ("Ann Bo", "Ob, Ann [USA]") not in got


def test_every_two_alike_words_share_a_pair_of_letters(spark):
    """All words of up to four letters over three, and random longer ones."""
    import difflib
    import itertools
    import random

    r = random.Random(1)
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc", repeat=n)] + ["".join(r.choices("abcd", k=r.randint(5, 9))) for _ in range(120)]
    side = lambda kind, name: spark.createDataFrame([("e", w, ["x", w], [w]) for w in words], f"event_id string, {name} string, words array<string>, last array<string>")
    got = {(x.deck, x.player) for x in players.alike_surnames(side(0, "deck"), side(1, "player")).where("NOT turned").collect()}
    m = difflib.SequenceMatcher(None, autojunk=False)
    want = set()
    for a in words:
        for b in words:
            m.set_seqs(a, b)
            if a == b or m.ratio() >= 0.8:
                want.add((a, b))
    assert got == want


def test_byes_and_countries_of_pages(spark):
    """A bye may be written as a match that was won; Byers is a player; a rank alone is no standing."""
    page = """<tr><td>1</td><td>Kilo, Kim</td><td>Won 2-0</td><td>vs.</td><td>* BYE *</td></tr><tr><td>2</td><td>Lee, Al</td><td>Lost 1-2</td><td>vs.</td><td>Byers, Bo [USA]</td></tr>
<tr><td>3</td><td>Hotel, Hana [ITA]</td><td>Bye</td></tr><tr><td>4</td><td>Odd, Row</td><td>vs.</td></tr><tr><td>5</td><td>No, Score</td><td>Won</td><td>vs.</td><td>Lee, Al</td></tr><tr><td>x</td><td>y</td><td>z</td></tr>
<tr><td>1</td><td>Kilo, Kim [DEU]</td></tr><tr><td>2</td><td>Pro Tour 2005</td></tr>"""
    rows = files.table_rows(spark.createDataFrame([("p", page)], "file string, text string")).cache()
    got = [(r.player, r.opponent, r.result) for r in files.results(rows).orderBy("row_ord").collect()]
    assert got == [("Kilo, Kim", None, "bye"), ("Lee, Al", "Byers, Bo [USA]", "lost"), ("Hotel, Hana [ITA]", None, "bye"), ("Odd, Row", None, "unread"), ("No, Score", None, "unread")]
    assert [tuple(r) for r in files.standings_rows(rows).orderBy("place").collect()] == [("p", 1, "Kilo, Kim [DEU]"), ("p", 3, "Hotel, Hana [ITA]")]


def test_spellings_of_one_player_never_meet_in_a_round(spark):
    gus, other, kim, kim2, lou = "Golf, Gus [ESP]", "Golf, Gus [USA]", "Kilo, Kim [DEU]", "Kilo, Kim [USA]", "Lima, Lou [USA]"
    seen = [("a", 1, other), ("a", 1, kim2), ("a", 2, gus), ("a", 2, kim), ("a", 3, kim2), ("a", 3, lou), ("b", 1, other), ("b", 1, gus)]
    standings = [("a", gus), ("a", kim), ("b", gus)]
    got = players.spellings(spark.createDataFrame(seen, "event_id string, round int, name string"), spark.createDataFrame(standings, "event_id string, name string"))
    assert {tuple(r) for r in got.collect()} == {("a", other, gus), ("a", kim2, kim)}


def test_pages_of_decks(spark):
    slugs = [("a", s) for s in ("afdecks", "gzdecks", "zadecks", "legacydecks", "decktech", "top8decks", "tedecks", "res3a")] + [("b", s) for s in ("standarddecks", "sampledecks", "t8decks", "f-topblock", "res12")]
    rows = spark.createDataFrame(slugs, "event_id string, slug string")
    got = [(r.event_id, r.slug) for r in files.deck_pages(rows).orderBy("event_id", "place").collect()]
    assert got == [("a", "afdecks"), ("a", "gzdecks"), ("a", "tedecks"), ("a", "top8decks"), ("b", "standarddecks"), ("b", "f-topblock"), ("b", "t8decks")]
    assert {r.slug: r.n for r in rows.select("slug", files.result_round(F.col("slug")).alias("n")).where("n IS NOT NULL").collect()} == {"res3a": 3, "res12": 12}


def test_pairings_count_once(spark):
    rows = [("e", 1, 1, "a", "b", "won"), ("e", 1, 2, "b", "a", "lost"), ("e", 2, 1, "a", "c", "drew"), ("e", 2, 2, "b", None, "bye")]
    got = {r.player: (r.wins, r.losses, r.draws, r.byes) for r in ingest.pairing_records(spark.createDataFrame(rows, "event_id string, round int, page_ord int, player string, opponent string, result string")).collect()}
    assert got == {"a": (1, 0, 1, 0), "b": (0, 1, 0, 1), "c": (0, 0, 1, 0)}


def test_text(spark):
    df = spark.createDataFrame([("  ＡＢ\tÉ x ", "<p>a&amp;b<script>no</script> c&nbsp;</p>")], "n string, h string")
    r = df.select(text.name_key(F.col("n")).alias("k"), text.loose_key(F.col("n")).alias("l"), text.html_text(F.col("h")).alias("t")).first()
    assert (r.k, r.l, r.t) == ("ab É x", "abex", "a&b c")
    assert text.decode_page("é".encode("cp1252")) == "é" == text.decode_page("é".encode())


def test_catalogue(spark, tmp_path):
    face = {"name": "A", "colors": ["R"]}
    raw = [{"id": "1", "oracle_id": "o1", "name": "A // B", "layout": "split", "card_faces": [face, {"name": "B", "colors": ["W"]}]}, {"id": "2", "name": "no oracle", "layout": "normal"}, {"id": "3", "oracle_id": "o3", "name": "X", "layout": "flip", "card_faces": [face]}]
    (tmp_path / "c.json.gz").write_bytes(gzip.compress(b"\n".join([json.dumps(r).encode() for r in raw] + [b"", b"3"])))
    (tmp_path / "c.json").write_text(json.dumps(raw))
    for name, lines in (("c.json.gz", True), ("c.json", False)):
        kept, rejected = catalog.projected(files.cards(spark, str(tmp_path / name), lines))
        assert [(r.id, r.colors) for r in kept.collect()] == [("1", ["W", "R"])]
        assert {r.reason: r.cards for r in rejected.collect()} == {"missing_oracle_id": 1, "missing_required_faces": 1}
    contents = {"lines.bulk": gzip.compress(b"\n".join([b"", *(json.dumps(r).encode() for r in raw), b"3", b"[1]"])), "array.bulk": b" \n" + json.dumps(raw, indent=1).encode(), "packed.json": gzip.compress(json.dumps(raw).encode()), "empty.bulk": b" \n", "[].bulk": b"[]"}
    for name, content in contents.items():
        (tmp_path / "bulk").mkdir(exist_ok=True)
        (tmp_path / "bulk" / name).write_bytes(content)
        manifest = spark.createDataFrame([(name, hashlib.sha256(content).hexdigest())], "file string, sha256 string")
        found = files.verified_cards(spark, str(tmp_path / "bulk"), manifest)
        assert sorted(r.id for r in found.collect()) == ([] if name in ("empty.bulk", "[].bulk") else ["1", "2", "3"]), name
    with pytest.raises(Exception, match="missing or changed"):
        files.verified_cards(spark, str(tmp_path / "bulk"), manifest.withColumn("sha256", F.lit("0"))).collect()
    named = spark.createDataFrame([(1, "A // B"), (2, "A")], "card_id int, name string")
    assert {tuple(r) for r in catalog.aliases(named).collect()} == {(1, "a // b", "canonical"), (1, "a", "face"), (1, "b", "face"), (2, "a", "canonical")}
    assert [r[0] for r in spark.createDataFrame([("Artifact Creature — Golem // Land",), ("Land",), ("Conspiracy",)], "t string").select(catalog.deck_group(F.col("t"))).collect()] == ["creature", "land", "misc"]


def test_responses(spark, tmp_path):
    deck = {"Mainboard": {"Bolt": {"id": "6F2F2A5A-0000-4000-8000-000000000001", "count": 4}, "Odd": {"id": "?", "count": 0}}, "Sideboard": {}, "metadata": {"game": "g", "format": "f"}}
    event = {"TID": "t1", "startDate": 1767225600, "topCut": "8", "standings": [{"wins": 1, "deckObj": deck}, {"wins": -1}]}
    (tmp_path / "r.json").write_text(json.dumps([event, {"TID": "t2", "isTeamEvent": True, "standings": []}]))
    events = files.responses(spark, str(tmp_path / "r.json"))
    assert [(r.event_id, r.occurred_on) for r in events.collect()] == [("t1", dt.date(2026, 1, 1))]
    assert {(r.zone, r.name, r.card_id, r.copies) for r in files.deck_lines(events).collect()} == {("Mainboard", "Bolt", "6f2f2a5a-0000-4000-8000-000000000001", 4), ("Mainboard", "Odd", None, None)}
    manifest = spark.createDataFrame([("r.json", hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest())], "file string, sha256 string")
    told = dt.datetime(2026, 2, 3, 4, 5)
    times = spark.createDataFrame([("r.json", told), ("other.json", None)], "file string, retrieved_at timestamp")
    assert [(r.retrieved_at, r.retrieved_at_basis) for r in files.retrieval(events, times).collect()] == [(told, "manifest")]
    assert [(r.retrieved_at > told, r.retrieved_at_basis) for r in files.retrieval(events, times.limit(0)).collect()] == [(True, "file_mtime")]
    assert files.verified(spark, str(tmp_path / "*.json"), manifest).count() == 1
    with pytest.raises(Exception, match="missing or changed"):
        files.verified(spark, str(tmp_path / "*.json"), manifest.withColumn("sha256", F.lit("0"))).collect()


def test_pages(spark, tmp_path):
    (tmp_path / "p.html").write_bytes("<table><tr><th>Table</th></tr><tr><td>1</td><td>Zoé, Ann [FR]</td><td>Won 2-0</td><td>vs.</td><td>Lee, Bo</td></tr></table>".encode("cp1252"))
    rows = files.results(files.table_rows(files.pages(spark, str(tmp_path)))).collect()
    assert [(r.player, r.opponent, r.result) for r in rows] == [("Zoé, Ann [FR]", "Lee, Bo", "won")]
    lists = spark.createDataFrame([(1, "4 Bolt\n2x Snap \n\nSideboard\n1 Rite"), (2, "SB: 3 Duress\nnote")], "deck_id int, text string")
    assert {tuple(r) for r in files.list_lines(lists).collect()} == {(1, "main", "Bolt", 4), (1, "main", "Snap", 2), (1, "side", "Rite", 1), (2, "side", "Duress", 3)}


def test_decks_of_pages(spark):
    new = """<div class="deck"><heading>Decks</heading></div>
<div class="deck"><heading>Ann Lee</heading><div class="sub">Pro Tour-Here 2009</div><td valign="top">4 Bolt<br>2 <a>Snap</a><br/><span class="decktotals">6 cards</span></td>
<td width="1" valign="top">3 Rite<p class="decktitle"><i>Sideboard</i></p>2 Duress<br>0 None</td><td valign="top">1 Bolt</td></div>"""
    old = """<p>Top</p><p><b><font size="+1">Bo Ray - Burn</font></b><br></p><td valign="top">4 Bolt<br>4 Bolt</td><td valign="top" class="statback">1 Rite</td>
<p><b><font size="+1">Cy Fox</font></b><br/>Control</p><td valign="top">1 Snap</td>"""
    rows = files.page_decks(spark.createDataFrame([("n", new), ("o", old), ("e", None), ("x", "")], "file string, text string")).collect()
    got = {(r.file, r.player, r.label, r.zone, r.name, r.copies) for r in rows}
    ann = {("main", "Bolt", 4), ("main", "Snap", 2), ("main", "Rite", 3), ("side", "Duress", 2), ("side", "Bolt", 1)}
    bo = {("main", "Bolt", 8), ("side", "Rite", 1)}
    assert got == {("n", "Ann Lee", None, *x) for x in ann} | {("o", "Bo Ray", "Burn", *x) for x in bo} | {("o", "Cy Fox", "Control", "main", "Snap", 1)}


def test_serving(spark):
    rows = spark.createDataFrame([("f", 1, 3.0), ("f", 2, None), ("f", 3, 3.0), ("f", 4, 9.0)], "format string, card_id int, score double")
    ranked = serving.ranked(rows)
    assert {r.card_id: r.ranking for r in ranked.collect()} == {4: 1, 1: 2, 3: 2, 2: 4}
    assert [r.card_id for r in serving.page(ranked, "score", True, 10).collect()] == [4, 1, 3, 2]
    assert [r.card_id for r in serving.page(ranked, "score", False, 2, 2).collect()] == [4, 2]
    with pytest.raises(ValueError):
        serving.page(ranked, "nonsense")


def test_publication(spark, tmp_path):
    store = publish.Store(spark, str(tmp_path / "store"))
    scores = spark.createDataFrame([(1, 2.0), (2, None)], "card_id int, score double")
    first = store.publish({"n": 1}, {"scores": scores}, {"finite": validate.not_finite(scores, "score")})
    assert store.publish({"n": 1}, {"scores": scores.orderBy(F.desc("card_id"))}, {}) == first
    with pytest.raises(ValueError, match="other results"):
        store.publish({"n": 1}, {"scores": scores.limit(1)}, {})
    bad = scores.union(spark.createDataFrame([(3, float("nan"))], scores.schema))
    with pytest.raises(ValueError, match="violated"):
        store.publish({"n": 2}, {"scores": bad}, {"finite": validate.not_finite(bad, "score")})
    second = store.publish({"n": 3}, {"scores": scores.limit(1)}, {})
    store.activate("f", first, None)
    with pytest.raises(ValueError, match="not None"):
        store.activate("f", second, None)
    store.activate("f", second, first)
    assert store.rollback("f", second) == first and store.active().first().run_id == first
    assert store.table(first, "scores").count() == 2
    with pytest.raises(LookupError):
        store.table(publish.identity("run", {"n": 2}), "scores")


def test_deck_objects_of_any_form(spark):
    uid = lambda n: f"6f2f2a5a-0000-4000-8000-{n:012d}"
    line = lambda n, count=1: {"id": uid(n), "count": count}
    decks = [
        {"Mainboard": {"Bolt": line(1, 4), "Other Bolt": line(1, 1), "Odd": {"id": "x", "count": 2}, "Text": {"id": uid(3), "count": "4"}, "Half": {"id": uid(4), "count": 1.5}, "None": None, "Zero": line(5, 0)}, "Sideboard": {}, "metadata": {"game": "g"}},
        {"Mainboard": {"Bolt": line(1, 4)}, "Sideboard": {"Duress": line(2, 3), "Bad": {"count": 1}}, "Commanders": {"B": line(9), "A": line(8)}},
        {"Mainboard": {"Bolt": line(1)}, "commander": {"A": line(7), "B": line(8), "C": line(9)}, "Sideboard": {"Bolt": line(1, 2)}},
        {"Mainboard": {}, "Commanders": {"A": line(7)}}, None, "text", [1], {"Mainboard": {"Flag": {"id": uid(1), "count": True}}},
    ]
    rows = [("e", [(json.dumps(d) if d is not None else None, " Burn " if i == 0 else "") for i, d in enumerate(decks)] + [("{broken", None)])]
    events = spark.createDataFrame(rows, "event_id string, standings array<struct<deckObj:string,archetype:string>>")
    got = {r.position: (r.label, {c.card_id[-1]: (c.main, c.side) for c in r.cards}, [x[-1] for x in r.commanders], r.sideboard_observed, r.skipped_main, r.skipped_side) for r in ingest.deck_entries(files.variant_lines(events)).collect()}
    assert got == {
        0: ("Burn", {"1": (5, 0)}, [], False, 5, 0), 1: (None, {"1": (4, 0), "2": (0, 3), "8": (1, 0), "9": (1, 0)}, ["8", "9"], False, 0, 1),
        2: (None, {"1": (1, 2), "7": (1, 0), "8": (1, 0), "9": (1, 0)}, [], True, 0, 0), 7: (None, {}, [], False, 1, 0),
    }


def test_places_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    from deckwright.streaming import movement

    day = lambda n, hour=1: dt.datetime(2026, 1, 1, hour) + dt.timedelta(days=n)
    schema = "ts timestamp, kind string, board string"
    first = [(day(0), "a", "x"), (day(0), "a", "x"), (day(0), "b", "x"), (day(1), "b", "x"), (day(1), "b", "x"), (day(1), "a", "x"), (day(1), "c", "x"), (day(2), "a", "y"), (day(5), "a", "x")]
    second = [(day(3), "c", "x"), (day(1), "a", "x"), (day(9), "b", "x"), (day(9), "b", "y")]  # of day 3 in time, of day 1 too late
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    run = lambda: {tuple(r) for r in movement.run(spark, source(), str(tmp_path / "out"), board="board", entry="kind").collect()}
    closed = lambda rows, until: {tuple(r) for r in movement.batch(spark.createDataFrame(rows, schema), "board", "kind").where(F.col("day") < F.lit(until)).collect()}
    assert run() == closed(first, day(3, 0))
    spark.createDataFrame(second, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    assert run() == closed(first + [second[0], *second[2:]], day(7, 0))
