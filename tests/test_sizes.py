"""Cases that show only in larger tables, made small."""

from __future__ import annotations

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from deckwright.bindings.tpch import Tables
from deckwright.functions import stats
from deckwright.functions.places import midranks
from deckwright.functions.text import html_text
from deckwright.operators import catalog, history, packages, scoring, serving, validate
from deckwright.plans import queries as plans
from deckwright.sources import files


@pytest.mark.parametrize(("name", "columns"), [("cheapest_price", ["card_id", "usd", "printing_id"]), ("score_per_dollar", ["format", "card_id", "per_dollar"])])
def test_amounts_halfway_between_cents(spark, tmp_path, name, columns):
    """8.075 and 32.495 are a little less than halfway as doubles, 1.125 is halfway."""
    c = duckdb.connect()
    for t in "region nation customer supplier part orders".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    c.sql("CREATE TABLE lineitem AS SELECT * REPLACE (CASE l_linenumber % 3 WHEN 0 THEN 8075e0 WHEN 1 THEN 32495e0 ELSE 1125e0 END AS l_extendedprice) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    c.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = c.sql(plans.oracle_sql()[name]).select(*columns).fetchall()
    got = plans.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    amounts = {r[0] for r in Tables(spark, str(tmp_path)).printings.where("usd > 0").select(F.col("usd").cast("string")).distinct().collect()}
    assert amounts <= {"8.07", "32.49", "1.13"}


@pytest.mark.parametrize(("name", "columns"), [("cheapest_price", ["card_id", "usd", "printing_id"]), ("score_per_dollar", ["format", "card_id", "per_dollar"])])
def test_amounts_of_more_than_two_decimals(spark, tmp_path, name, columns):
    """Halves of a cent that a double has a little less of, where a cent is what the price's thousandth is rounded by."""
    c = duckdb.connect()
    for t in "region nation customer supplier part orders".split():
        c.sql(f"COPY (FROM '/root/testdata/sf0.001/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    odd = [x for (x,) in c.sql("SELECT x FROM (SELECT (10000 * n + 4995) / 1e3 AS x FROM range(1, 9000) r(n)) WHERE round(x, 2) < x ORDER BY x LIMIT 6").fetchall()]
    assert len(odd) == 6
    c.sql(f"CREATE TABLE lineitem AS SELECT * REPLACE ({odd}[l_linenumber % 6 + 1]::DOUBLE AS l_extendedprice) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    c.sql(f"COPY lineitem TO '{tmp_path}/lineitem.parquet'")
    want = c.sql(plans.oracle_sql()[name]).select(*columns).fetchall()
    got = plans.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_places_need_no_task_that_holds_a_group(spark):
    rows = [(g, i, None if i % 11 == 0 else float(i * 7 % 13) if i % 3 else float(i)) for g in "ab" for i in range(300)] + [("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double")
    for groups in (["g"], []):
        want = df.withColumn("p", stats.midrank(F.col("v"), *groups)).select("g", "k", "p").collect()
        assert sorted(midranks(df, ["v"], *groups).select("g", "k", F.col("p_v").alias("p")).collect(), key=str) == sorted(want, key=str)
    features = plans.Run(spark, "/root/testdata/sf0.001").features()
    for name in ("constructed", "signature", "hidden-gem", "max-ratio"):
        plan = serving.ranked(scoring.run_method(name, features))._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(format#\d+L?, (?!_which)", plan), name


def test_values_as_of_a_day_fill_no_bins(spark):
    told = spark.createDataFrame([(1, dt.date(2000, 1, 1), 5), (1, dt.date(2000, 1, 1), 4), (1, dt.date(2009, 1, 1), 6)], "k int, day date, v int")
    asked = spark.createDataFrame([(1, dt.date(2008, 12, 31)), (1, dt.date(2009, 1, 1)), (1, dt.date(1999, 1, 1)), (2, dt.date(2009, 1, 1)), (1, None)], "k int, day date")
    rows = history.as_of(asked, told, "k", "day", "v")
    assert {(r.k, r.day): r.v for r in rows.collect()} == {(1, dt.date(2008, 12, 31)): 4, (1, dt.date(2009, 1, 1)): 6, (1, dt.date(1999, 1, 1)): None, (2, dt.date(2009, 1, 1)): None, (1, None): None}
    assert "sequence(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_claims_of_cards_are_counted_in_one_pass(spark):
    decks, cards, events, totals = plans.published(plans.Run(spark, "/root/testdata/sf0.001"))
    checks = validate.published_decks(decks, cards, events, totals)
    claims = [checks[rule] for rule in validate.CLAIMS]
    assert all(isinstance(x, validate.Where) for x in claims) and len({id(x.rows) for x in claims}) == 1


def test_printings_get_their_pictures_without_a_join(spark):
    c = catalog.catalogue(plans.Run(spark, "/root/testdata/sf0.001").t.raw_cards)
    assert c.printings.where("size(images) = 2").count() > 0
    assert "Join" not in c.printings._jdf.queryExecution().optimizedPlan().toString()


def test_pages_of_decks_are_read_once(spark):
    """Neither the search for main parts nor a filter on a line's text goes through all pages again."""
    body = '<td valign="top">2 Fire &amp; Ice<br>1 <b>Forest</b></td><p class="decktitle">Sideboard</p>3 Shock'
    page = f'<div class="deck"><heading>Jo &lt;Lee&gt;</heading><div class="sub">R&amp;D</div>{body}</div><div class="deck"><heading>No Main</heading><td class="statback" valign="top">1 Shock</td></div>'
    rows = files.page_decks(spark.createDataFrame([("p", page), ("q", None)], "file string, text string"))
    assert {tuple(r) for r in rows.collect()} == {("p", 1, "Jo <Lee>", "R&D", "main", "Fire & Ice", 2), ("p", 1, "Jo <Lee>", "R&D", "main", "Forest", 1), ("p", 1, "Jo <Lee>", "R&D", "side", "Shock", 3)}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # once for a deck's head and caption, once for its lines
    assert plan.count("ArrowEvalPython") == 2, plan
    texts = spark.createDataFrame([("a & b",), ("&amp;<i>x</i>  y\u00a0z",), ("<!-- & -->",), (None,), ("a > b",)], "s string").select(html_text(F.col("s")).alias("t"))
    assert [r.t for r in texts.collect()] == ["a & b", "& x y z", "", None, "a > b"]


def test_packages_meet_lines_once(spark, tmp_path, monkeypatch):
    """Four copies of each order, one of an event without lines of most, and an order twice; lines are read in one pass."""
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        c.sql(f"CREATE TABLE {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
    c.sql("CREATE TABLE n AS SELECT max(o_orderkey) + 1 AS n FROM orders")
    for t, k in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        c.sql(f"CREATE OR REPLACE TABLE {t} AS SELECT t.* REPLACE ({k} + i * n AS {k}) FROM {t} t, n, range(4) r(i)")
    c.sql("INSERT INTO orders FROM orders WHERE o_orderkey % 50 = 7")
    c.sql("DELETE FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE month(o_orderdate) = 5 AND o_orderkey % 2 = 0)")
    for t in "region nation customer supplier part orders lineitem".split():
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    read = []
    for module in (plans, packages):
        own = module.cut
        monkeypatch.setattr(module, "cut", lambda df, own=own: (read.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df))[1])
    columns = ["format", "items", "size", "decks", "lift"]
    got = plans.queries()["card_packages"](spark, str(tmp_path)).select(*columns).collect()
    want = c.sql(plans.oracle_sql()["card_packages"]).select(*columns).fetchall()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)
    assert sum(len(re.findall(r"Relation \[[^]]*l_orderkey", plan)) for plan in read) == 1


def test_printings_of_suppliers_of_six_digits(spark, tmp_path):
    """Neighbouring parts, sold by suppliers whose keys are 100,000 apart, have printings of one number."""
    c = duckdb.connect()
    for t in "region nation customer orders part supplier lineitem".split():
        c.sql(f"CREATE TABLE {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
    c.sql("INSERT INTO supplier SELECT t.* REPLACE (s_suppkey + i * 100000 AS s_suppkey) FROM supplier t, range(1, 4) r(i)")
    c.sql("INSERT INTO lineitem SELECT t.* REPLACE (l_partkey - i AS l_partkey, l_suppkey + i * 100000 AS l_suppkey, l_shipdate + INTERVAL 1 DAY AS l_shipdate) FROM lineitem t, range(1, 4) r(i) WHERE l_partkey >= i")
    for t in "region nation customer orders part supplier lineitem".split():
        c.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    assert c.sql("SELECT l_partkey * 100000 + l_suppkey FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) > 1 LIMIT 1").fetchall()
    columns = ["card_id", "source_id", "name_key", "layout", "colors", "printings", "pictures", "aliases", "faces"]
    got = plans.queries()["catalogue_outputs"](spark, str(tmp_path)).select(*columns).collect()
    want = c.sql(plans.oracle_sql()["catalogue_outputs"]).select(*columns).fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_texts_of_cards_do_not_move_with_printings(spark, monkeypatch):
    plans_cut = []
    monkeypatch.setattr(catalog, "cut", lambda df, own=catalog.cut: (plans_cut.append(df._jdf.queryExecution().optimizedPlan().toString()), own(df))[1])
    catalog.catalogue(plans.Run(spark, "/root/testdata/sf0.001").t.raw_cards)
    moved = re.search(r"first\((.*?)\) AS r#|first\((struct.*?), false\)", plans_cut[0])
    assert moved and "printing_id" in moved.group(0) and "oracle_text" not in moved.group(0)
