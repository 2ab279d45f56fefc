"""Smaller operators on hand-made rows."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from deckwright.functions import text
from deckwright.operators import catalog, clusters, cohort, export, history, matchups, packages, scoring, serving, sketches, usage, validate
from deckwright.sources import files


def test_faces(spark, tmp_path):
    picture = lambda u: {"normal": u}
    raw = [
        {"id": "1", "name": "One", "mana_cost": "{R}", "type_line": "Instant", "image_uris": picture("u1"), "artist": "x"},
        {"id": "2", "name": "A // B", "card_faces": [{"name": "A", "mana_cost": "{W}", "type_line": "Land", "image_uris": picture("ua")}, {"name": "B", "type_line": "Sorcery", "image_uris": {"small": "s"}}]},
        {"id": "3", "name": "Bare"},
    ]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, raw)))
    cards = files.cards(spark, str(tmp_path / "c.json"))
    assert {tuple(r) for r in catalog.images(cards).collect()} == {("1", None, "u1", "x"), ("2", 0, "ua", None)}
    assert {tuple(r) for r in catalog.shown(cards).collect()} == {("1", "{R}", "Instant"), ("2", "{W}", "Land // Sorcery"), ("3", None, None)}


def test_rules(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"version": "v1", "format_name": "f", "starts_on": "2026-03-01", "ends_before": "2026-09-01", "min_decklist_coverage": 0.5, "excluded_events": [{"source_event_id": "e", "reason": "why"}]}))
    rules, excluded = cohort.load_rules(spark, str(tmp_path / "r.json"))
    assert tuple(rules.first()) == ("f", dt.date(2026, 3, 1), dt.date(2026, 9, 1), 0.5, 2, "v1")
    assert [tuple(r) for r in excluded.collect()] == [("e", "why")]


def test_order_and_counts(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 1), ("b", 2, 2)], "k string, o int, v int")
    assert [(r.k, r.o) for r in validate.not_descending(rows, "k", "o", "v").collect()] == [("b", 2)]
    assert [r.n for r in validate.repeated(rows, "k").orderBy("k").collect()] == [3, 2]
    assert validate.recount(rows, rows).count() == 0 and validate.recount(rows, rows.limit(4)).count() == 1
    assert {r.k: r.v for r in usage.mode(rows.withColumn("v", F.col("v").cast("string")), ["k"], "v").collect()} == {"a": "5", "b": "1"}


def test_names_and_colors(spark):
    rows = spark.createDataFrame([("Æther Vial", ["U"]), ("Fire / Ice", []), ("Fire // Ice", None), ("x", ["U", "R"])], "n string, c array<string>")
    assert [r[0] for r in rows.select(text.card_name(F.col("n"))).collect()] == ["Aether Vial", "Fire // Ice", "Fire // Ice", "x"]
    chosen = lambda *c: [r[0] for r in rows.select(serving.color_filter(F.col("c"), c)).collect()]
    assert chosen("U") == [True, False, False, True] and chosen("C") == [False, True, False, False] and chosen("R", "C") == [False, True, False, True]
    within = [r[0] for r in rows.select(serving.identity_within(F.col("c"), ["U"])).collect()]
    assert within == [True, True, False, False]


def test_representative_and_cheapest(spark):
    p = spark.createDataFrame(
        [(1, 9, "S", "ja", dt.date(2020, 1, 1), ["paper"], "5.00", None), (2, 9, "S", "en", dt.date(2019, 1, 1), ["paper"], "5.00", "4.00"), (3, 9, "S", "en", dt.date(2019, 1, 1), ["paper"], "4.00", None), (4, 9, "S", "en", dt.date(2018, 1, 1), ["online"], "0.10", None)],
        "printing_id int, card_id int, set_code string, language string, released_on date, games array<string>, usd string, usd_foil string",
    ).withColumns({c: F.col(c).cast("decimal(12,2)") for c in ("usd", "usd_foil")})
    p = p.withColumns({"usd_etched": F.when(F.col("printing_id") == 3, F.lit(0)).cast("decimal(12,2)"), "collector_number": F.lit("1a"), "digital": F.lit(None).cast("boolean"), "oversized": F.lit(False), "set_type": F.lit("core"), "border_color": F.lit(None).cast("string")})
    assert catalog.representative(p).first().printing_id == 2
    assert tuple(map(str, catalog.cheapest(p).first())) == ("9", "4.00", "2")
    assert [r.printing_id for r in catalog.printing_page(p, 9, None, 9).collect()] == [2, 3, 4, 1]
    assert [r.printing_id for r in catalog.printing_page(p, 9, 2, 1).collect()] == [3, 4]
    assert catalog.cheapest(p.withColumn("border_color", F.lit("gold"))).count() == 0
    # a promo counts after the set it promotes, and a date of only a year from the year's end
    odd = spark.createDataFrame([(1, 5, "pS", "1", dt.date(2000, 5, 1)), (2, 5, "S", "x", dt.date(2001, 1, 1)), (3, 5, "S", "12b", dt.date(2001, 6, 1)), (4, 5, "T", "9", dt.date(2001, 6, 1)), (5, 6, "pT", "1", None)], "printing_id int, card_id int, set_code string, collector_number string, released_on date")
    odd = odd.withColumns({"language": F.lit("en"), "games": F.array(F.lit("paper"))})
    assert [r.printing_id for r in catalog.printing_page(odd, 5, None, 9).collect()] == [4, 3, 2, 1]
    twice = odd.unionByName(odd.where("printing_id = 1")).drop("games")
    assert catalog.merged(twice, "printing_id").count() == 5
    with pytest.raises(Exception, match="conflicting rows of 1"):
        catalog.merged(twice.unionByName(odd.drop("games").where("printing_id = 1").withColumn("language", F.lit("ja"))), "printing_id").collect()
    assert catalog.joint(p, ["S"], [], "online").first().eligible == 1


def test_decks_are_recounted_from_positions(spark):
    decks = spark.createDataFrame(
        [("f", 0, 10, "e2", True, 1, 0, 0, [1], []), ("f", 1, 11, "e1", None, None, None, None, [], [7]), ("f", 2, 12, "e1", False, 2, 1, 1, [], None)],
        "format string, position long, deck_id long, event_id string, made_cut boolean, wins int, losses int, draws int, commanders array<long>, sideboard array<long>",
    )
    events = spark.createDataFrame([("f", "e1", dt.date(2026, 1, 1)), ("f", "e2", dt.date(2026, 1, 2))], "format string, event_id string, occurred_on date")
    claims = "format string, card_id long, deck_count long, event_count long, copies long, cut_known long, cut_made long, record_decks long, wins long, losses long, draws long, positions array<long>, deck_copies array<long>"
    cards = spark.createDataFrame([("f", 1, 3, 2, 9, 2, 1, 2, 3, 1, 1, [0, 1, 2], [4, 4, 1]), ("f", 2, 1, 1, 4, 0, None, 0, 0, 0, 0, [1], [4]), ("f", 3, 1, 1, 2, 0, None, 0, 0, 0, 0, [3], [2]), ("f", 4, 2, 1, 2, 1, 0, 1, 2, 1, 1, [2, 1], None)], claims)
    totals = spark.createDataFrame([("f", 3)], "format string, decks long")
    got = {r.rule: r.violations for r in validate.counts(validate.published_decks(decks, cards, events, totals)).collect() if r.violations}
    # the third card lists a deck that isn't there, the fourth descends and has no copies, the last deck states no sideboard
    assert got == {"unlisted decks": 1, "ascending decks": 2, "unstated lists": 1, "card's events": 1, "card's copies": 1}
    late = validate.published_decks(decks.where("position < 2").withColumn("event_id", F.when(F.col("position") == 0, "e1").otherwise("e2")), cards.limit(0), events, totals)
    got = {r.rule: r.violations for r in validate.counts(late).collect() if r.violations}
    assert got == {"decks' total": 1, "newest first": 1, "unplayed deck": 2, "commander in the deck": 1}
    with pytest.raises(ValueError, match="unplayed deck"):
        validate.require(late)


def test_each_pairing_counts_once_and_cells_mirror(spark):
    told = [("e", 1, 1, 1, 2, "won"), ("e", 1, 2, 2, 1, "won"), ("e", 2, 2, 1, 2, "lost"), ("e", 2, 1, 2, 1, "drew"), ("e", 3, 1, 1, 3, "won"), ("e", 3, 1, 2, 4, "won"), ("e", 4, 1, 5, 5, "won"), ("e", 4, 1, 1, 9, "won"), ("e", 5, 1, 1, 6, "won")]
    decks = spark.createDataFrame([(1, "f", "A"), (2, "f", "B"), (3, "f", "A"), (4, "f", None), (5, "f", "A"), (6, "g", "A")], "deck_id int, format string, label string")
    cells = matchups.matrix(spark.createDataFrame(told, "event_id string, round int, seen int, deck int, opponent int, result string"), decks)
    got = {(r.label, r.against): (r.matches, r.wins, r.losses, r.draws, r.win_rate) for r in cells.collect()}
    assert got == {("A", "B"): (2, 1, 0, 1, 0.75), ("B", "A"): (2, 0, 1, 1, 0.25), ("A", "A"): (1, 1, 1, 0, None)}
    for r in cells.where("win_rate IS NOT NULL").collect():
        assert 0 <= r.low < r.win_rate < r.high <= 1
    table = {r.label: (r.A, r.B, r.C) for r in matchups.pivoted(cells, ["A", "B", "C"]).collect()}
    assert table == {"A": (None, 0.75, None), "B": (0.25, None, None)}


def test_packages_are_all_frequent_sets(spark):
    import itertools
    import random

    r = random.Random(3)
    decks = {(f, d): r.sample(range(9), r.randint(1, 6)) for f in "xy" for d in range(40)}
    rows = [(f, d, i) for (f, d), items in decks.items() for i in [*items, items[0], None]]
    got = {(x.format, tuple(x["items"])): (x.size, x.decks) for x in packages.packages(spark.createDataFrame(rows, "format string, deck_id int, item int"), 5).collect()}
    want = {}
    for f in "xy":
        for size in range(2, 7):
            for items in itertools.combinations(map(str, range(9)), size):
                n = sum(set(items) <= set(map(str, own)) for (g, _), own in decks.items() if g == f)
                if n >= 5:
                    want[(f, items)] = (size, n)
    assert got == want and max(size for size, _ in want.values()) >= 3
    assert packages.packages(spark.createDataFrame([], "format string, deck_id int, item int"), 2).count() == 0


def test_values_as_of_a_day(spark):
    day = lambda n: dt.date(2026, 1, 1) + dt.timedelta(days=n)
    told = [(1, day(0), 5), (1, day(0), 4), (1, day(3), 7), (1, day(200), 9), (2, day(50), 1), (None, day(1), 3), (3, day(1), None)]
    asked = [(1, day(n), "a") for n in (-1, 0, 2, 3, 29, 31, 199, 200, 400)] + [(2, day(49), "b"), (2, day(50), "b"), (3, day(9), "c"), (9, day(9), "d"), (None, day(9), "e"), (1, None, "f"), (1, day(3), "a")]
    rows = history.as_of(spark.createDataFrame(asked, "k int, day date, more string"), spark.createDataFrame(told, "k int, day date, v int"), "k", "day", "v")
    got = sorted(map(tuple, rows.collect()), key=str)
    want = []
    for k, d, more in asked:
        best = max(((t, -v, v) for key, t, v in told if key == k and k is not None and d is not None and v is not None and t <= d), default=None)
        want.append((k, d, more, best and best[2], best and best[0]))
    assert got == sorted(want, key=str) and sum(x[3] is not None for x in got) == 10
    assert history.as_of(spark.createDataFrame([], "k int, day date"), spark.createDataFrame(told, "k int, day date, v int"), "k", "day", "v").count() == 0


def test_runs_before_a_run(spark):
    rows = [("a", 2024, 1), ("b", 2025, 1), ("c", 2025, 2), ("d", 2026, 1), ("e", 2026, 9)]
    runs = spark.createDataFrame([(i, "s", "f", "m", dt.date(y - 1, 1, 1), dt.date(y, 1, 1), made, i == "d") for i, y, made in rows], "run_id string, source string, format string, method string, starts_on date, ends_before date, made int, active boolean")
    previous = serving.previous_run(runs)
    assert {r.run_id: r.previous_id for r in previous.collect()} == {"a": None, "b": "a", "c": "a", "d": "c", "e": "c"}  # never of the same window
    assert {tuple(r) for r in history.chain(previous).collect()} == {("b", "a", 1), ("c", "a", 1), ("d", "c", 1), ("d", "a", 2), ("e", "c", 1), ("e", "a", 2)}
    assert {r.run_id for r in serving.windows(runs).collect()} == {"a", "c", "d"}


def test_sketches_merge_over_any_window(spark):
    rows = [("f", c, dt.date(2026, 1, 1 + d), (c * 7919 + d * 31 + i * 17) % 5000, i % 4 + 1) for c in (1, 2) for d in range(20) for i in range(300 * c)]
    facts = spark.createDataFrame(rows, "format string, card_id int, occurred_on date, player int, copies int")
    stored = sketches.daily(facts)
    assert stored.count() == 40
    for first, last in ((1, 21), (5, 9)):
        inside = [x for x in rows if dt.date(2026, 1, first) <= x[2] < dt.date(2026, 1, last)]
        for r in sketches.over(stored, dt.date(2026, 1, first), dt.date(2026, 1, last), "card_id", ranks=(0.1, 0.5, 0.9)).collect():
            own = [x for x in inside if x[1] == r.card_id]
            exact = len({x[3] for x in own})
            assert r.decks == len(own) and abs(r.players - exact) <= 0.03 * exact and list(r.quantiles) in ([1, 2, 4], [1, 3, 4])
        total = sketches.over(stored, dt.date(2026, 1, first), dt.date(2026, 1, last), "format").first()
        assert abs(total.players - len({x[3] for x in inside})) <= 0.03 * len({x[3] for x in inside})


def test_exports_are_the_same_bytes_however_they_were_dealt(spark, tmp_path):
    rows = [(i % 7, None if i % 5 == 0 else f"n{i}\u00e9", dt.datetime(2026, 1, 1, i % 24)) for i in range(230)] + [(3, "same", None)] * 4
    df = spark.createDataFrame(rows, "k int, name string, at timestamp")
    told = [export.export(d, str(tmp_path / str(i)), ["k"], 40) for i, d in enumerate((df.repartition(1), df.repartition(7), df.orderBy(F.rand()).repartition(3, "name")))]
    assert len(set(told)) == 1 and told[0] != export.root(export.digests(export.ordered_lines(df.where("k < 6"), ["k"]), 40))
    files = {i: sorted((r.part, r.rows, r.sha256) for r in spark.read.parquet(str(tmp_path / str(i) / "files")).collect()) for i in range(3)}
    assert files[0] == files[1] == files[2] and [r[1] for r in files[0]] == [40] * 5 + [34]
    for part, _, sha in files[1]:
        (file,) = (tmp_path / "1" / "lines" / f"part={part}").glob("part-*")
        assert hashlib.sha256(file.read_bytes()).hexdigest() == sha
    lines = [line for part in range(6) for f in sorted((tmp_path / "1" / "lines" / f"part={part}").glob("part-*")) for line in f.read_text().splitlines()]
    assert [json.loads(x)["k"] for x in lines] == sorted(r[0] for r in rows) and json.loads(lines[0]).keys() == {"at", "k", "name"}
    summary = spark.read.parquet(str(tmp_path / "1" / "summary")).first()
    assert (summary.rows, summary.files, summary.sha256) == (234, 6, told[0])
    back = lambda i: spark.read.text(str(tmp_path / str(i) / "lines"))
    manifest = spark.read.parquet(str(tmp_path / "0" / "files"))
    assert export.verified(back(0), manifest).count() == 0
    assert [r.part for r in export.verified(back(0).where("part <> 3"), manifest).collect()] == [3]
    assert export.root(export.digests(export.ordered_lines(df.limit(0), ["k"]))) == hashlib.sha256(b"").hexdigest()
    assert export.root(manifest, 2) != export.root(manifest, 3)


def test_decks_without_labels_are_grouped(spark):
    import numpy as np

    rows, truth = [], {}
    for d in range(90):
        kind = d % 3
        truth[d] = kind
        rows += [("f", d, kind * 10 + (d * 7 + i * 3) % 8, 1 + (d + i) % 4) for i in range(5)] + [("f", d, 99, 4)]
    rows += [("g", 500, 1, 1), ("g", 501, 2, 1)]
    lines = spark.createDataFrame(rows, "format string, deck_id long, card_id int, copies int").dropDuplicates(["format", "deck_id", "card_id"])
    found, objective = clusters.clustered(lines, 3, 60)
    got = {r.deck_id: (r.cluster, r.distance) for r in found.where("format = 'f'").collect()}
    assert len(got) == 90 and len({(truth[d], c) for d, (c, _) in got.items()}) == 3  # cards apart, groups apart
    goal = {r.format: r for r in objective.collect()}
    assert goal["f"].clusters == 3 and goal["f"].distance < goal["f"].single and abs(goal["f"].distance - np.mean([x for _, x in got.values()])) < 1e-9
    assert goal["g"].decks == 2 and goal["g"].distance < 1e-9
    again, _ = clusters.clustered(lines.repartition(7), 3, 60)
    assert {(r.deck_id, r.cluster) for r in again.collect()} == {(r.deck_id, r.cluster) for r in found.collect()}
    # every deck is with its nearest medoid
    weights = clusters.vectors(lines.where("format = 'f'"))
    centers = {r.medoid: r.cluster for r in clusters.medoids(weights, 3, 60).collect()}
    own: dict[int, dict[int, float]] = {}
    for r in weights.collect():
        own.setdefault(r.deck_id, {})[r.card_id] = r.weight
    for d, x in own.items():
        alike = {c: sum(w * own[m].get(i, 0) for i, w in x.items()) for m, c in centers.items()}
        assert abs(max(alike.values()) - (1 - got[d][1])) < 1e-6


def test_four_outputs_of_the_catalogue(spark, tmp_path):
    face = lambda n, c: {"name": n, "colors": c, "type_line": "T", "image_uris": {"normal": f"u{n}"}, "artist": "x"}
    card = lambda i, oracle, lang, day, **more: {"id": i, "oracle_id": oracle, "name": more.pop("name", "Bolt"), "layout": more.pop("layout", "normal"), "lang": lang, "released_at": day, "set": "s", "set_name": "S", "collector_number": "1", "rarity": "rare", "games": ["paper", "arena"], **more}
    raw = [
        card("p1", "c1", "ja", "2026-01-01", colors=["R"]), card("p2", "c1", "en", "2020-01-01", colors=["R"], image_uris={"normal": "u"}), card("p3", "c1", "en", None, colors=["R"]), card("p2", "c1", "en", "2020-01-01", colors=["R"], image_uris={"normal": "u"}),
        card("q1", "c2", "en", "2021-05-05", name="Fire // Ice", layout="split", card_faces=[face("Fire", ["R"]), face("Ice", ["U"])]), card("q2", "c2", "en", "2021-05-05", name="Fire // Ice", layout="split", card_faces=[face("Fire", ["R"])]),
        card("x1", None, "en", "2021-05-05"), card("x2", "", "en", "2021-05-05"),
    ]
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, raw)))
    c = catalog.catalogue(files.cards(spark, str(tmp_path / "c.json")))
    assert {(r.card_id, r.source_id, r.name_key, tuple(r.colors)) for r in c.cards.collect()} == {("c1", "p2", "bolt", ("R",)), ("c2", "q1", "fire // ice", ("U", "R"))}
    assert {(r.card_id, r.face_index, r.name) for r in c.faces.collect()} == {("c2", 0, "Fire"), ("c2", 1, "Ice")}
    assert {tuple(r) for r in c.aliases.collect()} == {("c1", "bolt", "canonical"), ("c2", "fire // ice", "canonical"), ("c2", "fire", "face"), ("c2", "ice", "face")}
    assert {r.printing_id: (tuple(r.games), [(x.face_index, x.source_uri) for x in r.images]) for r in c.printings.collect()} == {
        "p1": (("arena", "paper"), []), "p2": (("arena", "paper"), [(None, "u")]), "p3": (("arena", "paper"), []), "q1": (("arena", "paper"), [(0, "uFire"), (1, "uIce")]),
    }
    assert {r.reason: r.cards for r in c.excluded.collect()} == {"missing_oracle_id": 2, "missing_required_faces": 1}


def test_commanders_go_by_their_commonest_spelling(spark):
    decks = spark.createDataFrame([(1, "f", None), (2, "f", None), (3, "f", "Own"), (4, "g", None), (5, "f", None)], "deck_id int, format string, label string")
    leads = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (2, 2, 11), (3, 1, 10), (4, 1, 10)], "deck_id int, pos int, card_id int")
    lines = spark.createDataFrame([(1, 10, "Z // Back"), (2, 10, "Z"), (3, 10, "Z"), (1, 11, "B"), (2, 11, "A"), (4, 10, "Z // Back"), (5, 10, "Z"), (9, 10, "Q")], "deck_id int, card_id int, name string")
    got = {r.deck_id: r.archetype for r in usage.spelled_commanders(decks, leads, lines).collect()}
    assert got == {1: "A + Z", 2: "A + Z", 3: "Own", 4: "Z // Back", 5: None}


def test_identity_of_a_method_follows_its_configuration(monkeypatch):
    own = {n: scoring.identity(n) for n in scoring.METHODS}
    assert len({x[2] for x in own.values()}) == len(own) and scoring.identity("signature") == own["signature"]
    monkeypatch.setitem(scoring.CONFIG, "signature", scoring.SIGNATURE | {"labelled": 11.0})
    assert scoring.identity("signature")[2] != own["signature"][2] and scoring.identity("constructed") == own["constructed"]
