"""SQL counterparts of the named queries, for another engine over the same tables.

Each text starts from ``BINDING``, the canonical tables as common table expressions; unused ones cost nothing.
"""

from __future__ import annotations

from ..bindings import pages
from ..operators.matchups import Z

BINDING = """
WITH entries AS (
  SELECT o_orderkey AS deck_id, r_name || '-' || strftime(date_trunc('month', o_orderdate), '%Y-%m') AS event_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS occurred_on, r_name AS format, c_mktsegment, o_orderstatus, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
deck_cards AS (SELECT l_orderkey AS deck_id, l_partkey AS card_id, 1 + CAST(floor(min(l_quantity)) AS INT) % 4 AS copies FROM lineitem GROUP BY ALL),
listed AS (SELECT DISTINCT l_orderkey AS deck_id FROM lineitem),
all_decks AS (
  SELECT deck_id, event_id, CASE WHEN deck_id % 5 <> 0 THEN c_mktsegment END AS label, deck_id AS source_ord, deck_id % 97 <> 0 AS complete
  FROM entries WHERE deck_id IN (SELECT deck_id FROM listed)),
all_events AS (
  SELECT event_id, occurred_on, format, count(*) AS players, count(l.deck_id) AS decklists
  FROM entries e LEFT JOIN listed l ON e.deck_id = l.deck_id GROUP BY event_id, occurred_on, format),
all_standings AS (
  SELECT deck_id, event_id, CASE WHEN o_orderstatus <> 'P' THEN deck_id % 7 END AS wins, CASE WHEN o_orderstatus <> 'P' THEN (deck_id // 7) % 5 END AS losses,
         CASE WHEN o_orderstatus <> 'P' THEN (deck_id // 35) % 3 END AS draws,
         CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN true WHEN substr(o_orderpriority, 1, 1) IN ('3', '4') THEN false END AS made_cut
  FROM entries),
cards AS (
  SELECT p_partkey AS card_id, CASE WHEN p_partkey % 40 = 0 THEN ['Forest', 'Island', 'Mountain', 'Plains', 'Snow-Covered Forest', 'Snow-Covered Island', 'Snow-Covered Mountain', 'Snow-Covered Plains', 'Snow-Covered Swamp', 'Snow-Covered Wastes', 'Swamp', 'Wastes'][CAST((p_partkey // 40) % 12 + 1 AS INT)] ELSE p_name END AS name,
         CASE WHEN p_partkey % 9 <> 0 THEN kind END AS type_line, CASE WHEN p_partkey % 9 <> 0 THEN p_name || ' ' || p_brand END AS oracle_text,
         CASE WHEN p_partkey % 9 = 0 THEN [kind, 'Sorcery'] END AS face_types, CASE WHEN p_partkey % 9 = 0 THEN [p_name, p_brand] END AS face_texts,
         CASE WHEN p_size % 7 <> 0 THEN list_filter([CASE WHEN p_size & 1 <> 0 THEN 'W' END, CASE WHEN p_size & 2 <> 0 THEN 'U' END, CASE WHEN p_size & 4 <> 0 THEN 'B' END, CASE WHEN p_size & 8 <> 0 THEN 'R' END, CASE WHEN p_size & 16 <> 0 THEN 'G' END], lambda x: x IS NOT NULL) END AS colors
  FROM (SELECT *, ['Creature', 'Artifact Creature', 'Artifact Land', 'Instant // Land', 'Legendary Planeswalker', 'Enchantment', 'Sorcery', 'Conspiracy', 'Battle', 'Artifact', 'Tribal Instant'][CAST(p_partkey % 11 + 1 AS INT)] || ' — ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS kind FROM part)),
basics AS (SELECT card_id FROM cards WHERE name IN ('Forest', 'Island', 'Mountain', 'Plains', 'Snow-Covered Forest', 'Snow-Covered Island', 'Snow-Covered Mountain', 'Snow-Covered Plains', 'Snow-Covered Swamp', 'Snow-Covered Wastes', 'Swamp', 'Wastes')),
sold AS (SELECT l_partkey, l_suppkey, CAST(min(l_shipdate) AS DATE) AS released_on, min(round(l_extendedprice, 2)) AS price FROM lineitem GROUP BY ALL),
printings AS (
  SELECT l_partkey * 100000 + l_suppkey AS printing_id, l_partkey AS card_id, CASE WHEN l_suppkey % 4 = 0 THEN 'p' ELSE '' END || 'S' || CAST(s_nationkey % 3 AS VARCHAR) AS set_code,
         CASE WHEN (l_partkey + l_suppkey) % 17 = 0 THEN 'A' ELSE '' END || CAST(l_suppkey % 90 AS VARCHAR) || CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 'b' ELSE '' END AS collector_number,
         (l_partkey + l_suppkey) % 19 = 0 AS digital, (l_partkey + l_suppkey) % 23 = 0 AS oversized, CASE WHEN (l_partkey + l_suppkey) % 31 = 0 THEN 'memorabilia' ELSE 'core' END AS set_type, CASE WHEN (l_partkey + l_suppkey) % 37 = 0 THEN 'gold' ELSE 'black' END AS border_color,
         ['common', 'uncommon', 'rare', 'mythic'][(l_partkey + l_suppkey) % 4 + 1] AS rarity, CASE WHEN l_suppkey % 3 <> 0 THEN 'en' ELSE 'ja' END AS language,
         CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN ['online'] ELSE ['paper', 'online'] END AS games,
         CASE WHEN (l_partkey + l_suppkey) % 13 = 0 THEN CAST(date_trunc('year', released_on) AS DATE) WHEN (l_partkey + l_suppkey) % 29 <> 0 THEN released_on END AS released_on,
         CASE WHEN (l_partkey + l_suppkey) % 4 = 1 THEN CAST(CAST(price / 1000 AS DECIMAL(12, 2)) - 1 AS DECIMAL(12, 2)) END AS usd_etched,
         CASE WHEN (l_partkey + l_suppkey) % 7 = 0 THEN CAST(0 AS DECIMAL(12, 2)) WHEN (l_partkey + l_suppkey) % 11 <> 0 THEN CAST(price / 1000 AS DECIMAL(12, 2)) END AS usd,
         CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN CAST(CAST(price / 1000 AS DECIMAL(12, 2)) * 2 AS DECIMAL(12, 2)) END AS usd_foil
  FROM sold JOIN supplier ON l_suppkey = s_suppkey),
originals AS (
  SELECT p.*, row_number() OVER (PARTITION BY card_id ORDER BY language <> 'en', NOT list_contains(games, 'paper'),
           set_code LIKE 'p%' AND EXISTS (SELECT 1 FROM printings o WHERE o.card_id = p.card_id AND 'p' || o.set_code = p.set_code),
           coalesce(released_on + CASE WHEN dayofyear(released_on) = 1 THEN 364 ELSE 0 END, DATE '9999-12-31'),
           coalesce(try_cast(regexp_extract(collector_number, '^[0-9]+') AS DOUBLE), CAST('NaN' AS DOUBLE)), collector_number, printing_id) AS place
  FROM printings p),
offers AS (
  SELECT card_id, printing_id, unnest([usd, usd_foil, usd_etched]) AS usd FROM printings
  WHERE list_contains(games, 'paper') AND NOT digital AND NOT oversized AND set_type <> 'memorabilia' AND border_color <> 'gold'),
sideboards AS (SELECT l_orderkey AS deck_id, l_partkey AS card_id, 1 + CAST(floor(min(l_quantity)) AS INT) % 3 AS copies FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3 GROUP BY ALL),
commanders AS (
  SELECT deck_id, pos, card_id FROM (
    SELECT deck_id, card_id, row_number() OVER (PARTITION BY deck_id ORDER BY q DESC, card_id) AS pos
    FROM (SELECT l_orderkey AS deck_id, l_partkey AS card_id, max(l_quantity) AS q FROM lineitem GROUP BY ALL) WHERE deck_id % 5 = 0)
  WHERE pos <= deck_id % 2 + 1),
rules AS (
  SELECT * FROM (VALUES {rules}) AS t(format, starts_on, ends_before, min_coverage, players_per_game)),
excluded AS (SELECT * FROM (VALUES {excluded}) AS t(event_id, listed)),
judged AS (
  SELECT e.*, starts_on, ends_before, players_per_game, CAST(decklists AS DOUBLE) / nullif(CAST(players AS DOUBLE), 0) AS coverage,
         CASE WHEN listed IS NOT NULL THEN 'listed: ' || listed WHEN starts_on IS NULL THEN 'format'
              WHEN occurred_on < starts_on OR occurred_on >= ends_before THEN 'window' WHEN players = 0 THEN 'coverage unknown'
              WHEN CAST(decklists AS DOUBLE) / CAST(players AS DOUBLE) < min_coverage THEN 'coverage low' END AS reason
  FROM all_events e LEFT JOIN rules USING (format) LEFT JOIN excluded USING (event_id)),
events AS (SELECT * FROM judged WHERE reason IS NULL),
decks AS (SELECT d.*, e.format, e.occurred_on, e.starts_on, e.ends_before, e.players_per_game FROM all_decks d JOIN events e USING (event_id) WHERE complete),
standings AS (SELECT s.*, e.format FROM all_standings s JOIN events e USING (event_id)),
results AS (SELECT d.*, wins, losses, draws, made_cut, wins IS NOT NULL AND losses IS NOT NULL AND draws IS NOT NULL AS known FROM decks d LEFT JOIN standings s USING (deck_id)),
facts AS (
  SELECT r.*, card_id, copies, 11 - (datediff('day', occurred_on, ends_before) - 1) // least(30, CAST(ceil(datediff('day', starts_on, ends_before) / 12.0) AS INT)) AS period
  FROM results r JOIN deck_cards USING (deck_id)),
usage AS (
  SELECT format, card_id, count(*) AS deck_count, count(DISTINCT event_id) AS event_count, CAST(sum(copies) AS BIGINT) AS copies, count(*) FILTER (copies >= 4) AS playsets,
         count(made_cut) AS cut_known, CAST(sum(CAST(made_cut AS INT)) AS BIGINT) AS cut_made, count(*) FILTER (known) AS record_decks,
         CAST(coalesce(sum(wins) FILTER (known), 0) AS BIGINT) AS wins, CAST(coalesce(sum(losses) FILTER (known), 0) AS BIGINT) AS losses, CAST(coalesce(sum(draws) FILTER (known), 0) AS BIGINT) AS draws,
         max(players_per_game) AS ppg, count(*) FILTER (period BETWEEN 0 AND 5) AS early, count(*) FILTER (period BETWEEN 6 AND 11) AS late
  FROM facts GROUP BY format, card_id),
field AS (
  SELECT format, count(*) AS deck_count, count(label) AS labelled, count(made_cut) AS cut_known, CAST(sum(CAST(made_cut AS INT)) AS BIGINT) AS cut_made, count(*) FILTER (known) AS record_decks,
         CAST(coalesce(sum(wins) FILTER (known), 0) AS BIGINT) AS wins, CAST(coalesce(sum(losses) FILTER (known), 0) AS BIGINT) AS losses, CAST(coalesce(sum(draws) FILTER (known), 0) AS BIGINT) AS draws, max(players_per_game) AS ppg,
         count(*) FILTER (11 - (datediff('day', occurred_on, ends_before) - 1) // least(30, CAST(ceil(datediff('day', starts_on, ends_before) / 12.0) AS INT)) BETWEEN 0 AND 5) AS early,
         count(*) FILTER (11 - (datediff('day', occurred_on, ends_before) - 1) // least(30, CAST(ceil(datediff('day', starts_on, ends_before) / 12.0) AS INT)) BETWEEN 6 AND 11) AS late
  FROM results GROUP BY format),
label_counts AS (SELECT format, card_id, label, count(*) AS decks FROM facts WHERE label IS NOT NULL GROUP BY ALL),
top_labels AS (SELECT *, row_number() OVER (PARTITION BY format, card_id ORDER BY decks DESC, label) AS place, count(*) OVER (PARTITION BY format, card_id) AS labels FROM label_counts),
concentration AS (
  SELECT format, card_id, CAST(sum(decks) AS BIGINT) AS labelled, CAST(sum(decks * (decks - 1)) AS DOUBLE) / nullif(CAST(sum(decks) * (sum(decks) - 1) AS DOUBLE), 0) AS concentration
  FROM label_counts GROUP BY format, card_id),
field_concentration AS (
  SELECT format, CAST(sum(n * (n - 1)) AS DOUBLE) / nullif(CAST(sum(n) * (sum(n) - 1) AS DOUBLE), 0) AS concentration
  FROM (SELECT format, label, count(*) AS n FROM decks WHERE label IS NOT NULL GROUP BY ALL) GROUP BY format),
features AS (
  SELECT u.*, u.wins + u.losses + u.draws AS games,
         (CAST(u.wins AS DOUBLE) + CAST(u.draws AS DOUBLE) / CAST(u.ppg AS DOUBLE)) / nullif(CAST(u.wins + u.losses + u.draws AS DOUBLE), 0) AS win_rate,
         f.deck_count AS field_decks, (CAST(f.wins AS DOUBLE) + CAST(f.draws AS DOUBLE) / CAST(f.ppg AS DOUBLE)) / nullif(CAST(f.wins + f.losses + f.draws AS DOUBLE), 0) AS field_win,
         CAST(f.cut_made AS DOUBLE) / nullif(CAST(f.cut_known AS DOUBLE), 0) AS field_cut, f.early AS field_early, f.late AS field_late,
         CAST(u.deck_count AS DOUBLE) / CAST(f.deck_count AS DOUBLE) AS incidence, CAST(u.cut_made AS DOUBLE) / nullif(CAST(u.cut_known AS DOUBLE), 0) AS cut_rate,
         c.labelled, c.concentration, fc.concentration AS field_concentration, t.label AS home, t.decks AS home_support, h.n AS home_decks
  FROM (SELECT * FROM usage WHERE card_id NOT IN (SELECT card_id FROM basics)) u JOIN field f USING (format) LEFT JOIN field_concentration fc USING (format) LEFT JOIN concentration c USING (format, card_id)
  LEFT JOIN (SELECT * FROM top_labels WHERE place = 1) t USING (format, card_id)
  LEFT JOIN (SELECT format, label, count(*) AS n FROM decks WHERE label IS NOT NULL GROUP BY ALL) h ON h.format = u.format AND h.label = t.label)
"""

#: A percentile of ``{v}`` within ``{by}``; ties share the average rank and NULLs don't count.
MIDRANK = "CASE WHEN {v} IS NOT NULL THEN (CAST(rank() OVER (PARTITION BY {by}, {v} IS NULL ORDER BY {v}) AS DOUBLE) + (CAST(count(*) OVER (PARTITION BY {by}, {v}) AS DOUBLE) - 1e0) / 2e0 - 5e-1) / CAST(count({v}) OVER (PARTITION BY {by}) AS DOUBLE) END"


def midrank(v: str, by: str = "format") -> str:
    return MIDRANK.format(v=v, by=by)


def blend(*parts: tuple[str, str]) -> str:
    top = " + ".join(["0e0", *(f"coalesce({w} * {v}, 0e0)" for w, v in parts)])
    bottom = " + ".join(["0e0", *(f"CASE WHEN {v} IS NOT NULL THEN {w} ELSE 0e0 END" for w, v in parts)])
    return f"({top}) / nullif({bottom}, 0e0)"


WIN = "CASE WHEN games > 0 THEN (win_rate * CAST(games AS DOUBLE) + {k} * field_win) / (CAST(games AS DOUBLE) + {k}) END"
CUT = "CASE WHEN cut_known > 0 AND field_cut <> 0 THEN ((cut_rate * CAST(cut_known AS DOUBLE) + {k} * field_cut) / (CAST(cut_known AS DOUBLE) + {k})) / field_cut END"

CONSTRUCTED = f"""
parts AS (SELECT *, {WIN.format(k='6e1')} - field_win AS a, {CUT.format(k='2e1')} AS b, incidence AS c FROM features),
placed AS (SELECT *, {midrank('a')} AS pa, {midrank('b')} AS pb, {midrank('c')} AS pc FROM parts),
mixed AS (SELECT *, {blend(('6e-1', 'pa'), ('25e-2', 'pb'), ('15e-2', 'pc'))} AS m FROM placed),
constructed AS (SELECT format, card_id, 1e2 * {midrank('m')} AS score FROM mixed),
rankings AS (SELECT c.*, rank() OVER (PARTITION BY format ORDER BY score DESC NULLS LAST) AS ranking FROM constructed c)"""


#: The groups of a deck list, from the front face's words before the dash.
GROUP = "CASE " + " ".join(f"WHEN list_contains(string_split(trim(lower(split_part(split_part(shown, ' // ', 1), '—', 1))), ' '), '{g}') THEN '{g}'" for g in ("creature", "land", "planeswalker", "battle", "instant", "sorcery", "artifact", "enchantment")) + " ELSE 'misc' END"

#: Checks of a score run over ``run`` and ``scores``.
RUN_RULES = {
    "repeated card": "FROM (SELECT 1 FROM run GROUP BY format, card_id HAVING count(*) > 1)",
    "cut known": "FROM run WHERE (cut_made IS NULL) <> (cut_known = 0)",
    "label known": "FROM run WHERE (home IS NULL) <> (coalesce(labelled, 0) = 0)",
    "record or copies": "FROM run WHERE record_decks > deck_count OR copies < deck_count",
    "win rate known": "FROM run WHERE (win_rate IS NULL) <> (wins + losses + draws = 0)",
    "bounds": "FROM run WHERE event_count > deck_count OR cut_known > deck_count OR cut_made > cut_known",
    "labelled decks": "FROM run WHERE coalesce(home_support, 0) > coalesce(labelled, 0) OR coalesce(labelled, 0) > deck_count",
    "unscored card": "FROM run ANTI JOIN scores USING (format, card_id)",
    "unknown card": "FROM scores ANTI JOIN run USING (format, card_id)",
    "repeated score": "FROM (SELECT 1 FROM scores GROUP BY format, card_id HAVING count(*) > 1)",
    "not finite": "FROM scores WHERE isnan(score) OR isinf(score)",
    "incomplete run": "FROM (SELECT format, count(*) AS n FROM run GROUP BY format) FULL JOIN (SELECT format, count(*) AS m FROM scores GROUP BY format) USING (format) WHERE n IS DISTINCT FROM m",
}


def violations(rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, count(*) AS violations {text}" for rule, text in rules.items())


def recount_sql(seeded: bool) -> str:
    """Published decks and cards as rows, with the mistakes of the seeded query or as they are; each rule by itself."""

    def put(when: str, wrong: str, right: str) -> str:
        return f"CASE WHEN {when} THEN {wrong} ELSE {right} END" if seeded else right

    cards = f"""
, ordered AS (SELECT r.*, row_number() OVER (PARTITION BY format ORDER BY occurred_on DESC, event_id, source_ord) - 1 AS position FROM results r),
deck AS (
  SELECT format, position, {put("deck_id % 137 = 0", "deck_id - 1", "deck_id")} AS deck_id, deck_id AS own, {put("deck_id % 107 = 0", "'nowhere'", "event_id")} AS event_id, {put("deck_id % 101 = 0", "NULL", "made_cut")} AS made_cut,
    known, CASE WHEN known THEN {put("deck_id % 103 = 0", "wins + 1", "wins")} END AS wins, CASE WHEN known THEN losses END AS losses, CASE WHEN known THEN draws END AS draws FROM ordered),
dated AS (SELECT d.*, e.occurred_on AS day FROM deck d LEFT JOIN (SELECT * FROM events {"WHERE event_id <> 'AFRICA-1997-05'" if seeded else ""}) e USING (format, event_id)),
line AS (SELECT format, card_id, position, copies, row_number() OVER (PARTITION BY format, card_id ORDER BY position) AS i, count(*) OVER (PARTITION BY format, card_id) AS n FROM facts f JOIN (SELECT deck_id, position FROM ordered) USING (deck_id)),
shown_lines AS (SELECT l.format, card_id, {put("card_id % 19 = 0", "(SELECT 0) + position", put("card_id % 29 = 0", "position + 1000000", "position"))} AS position, {put("card_id % 7 = 0", "copies + CASE WHEN i = 1 THEN 1 ELSE 0 END", put("card_id % 23 = 0", "NULL", "copies"))} AS copies, n FROM line l),
again AS (
  SELECT l.format, card_id, count(*) AS deck_count, count(DISTINCT event_id) AS event_count, coalesce(sum(copies), 0) AS copies, count(made_cut) AS cut_known, sum(CAST(made_cut AS INT)) AS cut_made, count(*) FILTER (known) AS record_decks,
    coalesce(sum(wins), 0) AS wins, coalesce(sum(losses), 0) AS losses, coalesce(sum(draws), 0) AS draws FROM shown_lines l LEFT JOIN deck d ON d.format = l.format AND d.position = l.position GROUP BY l.format, card_id),
claimed AS (SELECT format, card_id, {put("card_id % 13 = 0", "deck_count + 1", "deck_count")} AS deck_count, {put("card_id % 17 = 0", "event_count + 1", "event_count")} AS event_count, copies, cut_known, cut_made, record_decks, wins, losses, draws FROM usage),
met AS (SELECT * FROM claimed c JOIN (SELECT format, card_id, deck_count AS a_deck_count, event_count AS a_event_count, copies AS a_copies, cut_known AS a_cut_known, cut_made AS a_cut_made, record_decks AS a_record_decks, wins AS a_wins, losses AS a_losses, draws AS a_draws FROM again) USING (format, card_id)),
sizes AS (SELECT format, count(*) AS size FROM deck GROUP BY format),
side AS (SELECT DISTINCT deck_id AS own, card_id FROM (SELECT l_orderkey AS deck_id, l_partkey AS card_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3)),
apart AS (SELECT format, position, card_id FROM deck d JOIN commanders c ON c.deck_id = d.own {"WHERE own % 109 <> 0 AND own % 113 <> 0 UNION ALL SELECT format, position, -1 FROM deck WHERE own % 109 = 0" if seeded else ""})"""
    differs = lambda *names: " OR ".join(f"{n} IS DISTINCT FROM a_{n}" for n in names)
    rules = {
        "decks' total": f"FROM (SELECT format, size, {put("format = 'ASIA'", 'size + 1', 'size')} AS told FROM sizes) WHERE size <> told",
        "repeated deck": "FROM (SELECT format, deck_id FROM deck GROUP BY ALL HAVING count(*) > 1)",
        "event of a deck": "FROM dated WHERE day IS NULL",
        "newest first": "FROM dated a JOIN dated b ON a.format = b.format AND b.position = a.position + 1 WHERE b.day > a.day",
        "unlisted decks": "FROM usage WHERE card_id % 7 <> 0 AND card_id % 23 = 0" if seeded else "FROM usage WHERE false",
        "ascending decks": "FROM (SELECT DISTINCT format, card_id FROM line WHERE (card_id % 19 = 0 AND n > 1) OR (card_id % 19 <> 0 AND card_id % 29 = 0))" if seeded else "FROM usage WHERE false",
        "unplayed deck": "FROM deck d WHERE NOT EXISTS (FROM shown_lines l WHERE l.format = d.format AND l.position = d.position)",
        "unstated lists": "FROM deck WHERE (own % 109 <> 0 AND own % 113 = 0) OR (own % 127 <> 0 AND own % 131 = 0)" if seeded else "FROM deck WHERE false",
        "commander in the deck": "FROM (SELECT DISTINCT format, position FROM apart a WHERE NOT EXISTS (FROM shown_lines l WHERE l.format = a.format AND l.position = a.position AND l.card_id = a.card_id))",
        "sideboard's card twice": "FROM deck WHERE own % 127 = 0" if seeded else "FROM deck WHERE false",
        "card's decks": f"FROM met WHERE {differs('deck_count')}", "card's copies": f"FROM met WHERE {differs('copies')}", "card's events": f"FROM met WHERE {differs('event_count')}",
        "card's cuts": f"FROM met WHERE {differs('cut_known', 'cut_made')}", "card's record": f"FROM met WHERE {differs('record_decks', 'wins', 'losses', 'draws')}",
    }
    quoted = lambda rule: rule.replace("'", "''")
    return cards + " " + " UNION ALL ".join(f"SELECT '{quoted(rule)}' AS rule, count(*) AS violations {text}" for rule, text in rules.items())


#: Published runs and their previous ones.
RUNS = """
, runs AS (
  SELECT format || '-' || y || '-' || n AS run_id, 'orders' AS source, format, CASE WHEN n = 3 AND y % 2 = 0 THEN 'signature' ELSE 'constructed' END AS method, make_date(y, 1, 1) AS starts_on,
    CASE WHEN n = 3 THEN make_date(y, 7, 1) ELSE make_date(y + 1, 1, 1) END AS ends_before, (y * 7 + n * 5) % 11 AS made, n = 1 AND y % 3 = 0 AS active
  FROM (SELECT DISTINCT format, year(occurred_on) AS y FROM all_events) CROSS JOIN (VALUES (1), (2), (3)) AS t(n)),
earlier AS (
  SELECT r.run_id, (SELECT o.run_id FROM runs o WHERE o.source = r.source AND o.format = r.format AND o.method = r.method AND o.ends_before < r.ends_before ORDER BY o.ends_before DESC, o.made DESC, o.run_id DESC LIMIT 1) AS previous_id FROM runs r)
"""

MATCHUPS = """
, seats AS (
  SELECT a.format, a.label, b.label AS against, ['won', 'lost', 'drew'][a.deck_id % 3 + 1] AS r FROM decks a CROSS JOIN (VALUES (1), (2), (3)) AS t(n) JOIN decks b ON b.deck_id = a.deck_id + n AND b.format = a.format
  WHERE a.deck_id % (2 * n) < n AND a.label IS NOT NULL AND b.label IS NOT NULL),
both_seats AS (SELECT * FROM seats UNION ALL SELECT format, against, label, CASE r WHEN 'won' THEN 'lost' WHEN 'lost' THEN 'won' ELSE r END FROM seats WHERE label <> against),
each_cell AS (SELECT format, label, against, count(*) AS matches, CASE WHEN label = against THEN count(*) FILTER (r <> 'drew') ELSE count(*) FILTER (r = 'won') END AS wins,
  CASE WHEN label = against THEN count(*) FILTER (r <> 'drew') ELSE count(*) FILTER (r = 'lost') END AS losses, count(*) FILTER (r = 'drew') AS draws FROM both_seats GROUP BY format, label, against),
shares AS (SELECT *, CAST(matches AS DOUBLE) AS n, (CAST(wins AS DOUBLE) + CAST(draws AS DOUBLE) * 5e-1) / CAST(matches AS DOUBLE) AS p, CAST({zz} AS DOUBLE) AS zz FROM each_cell),
cells AS (
  SELECT *, CASE WHEN label <> against THEN CAST(wins * 2 + draws AS DOUBLE) / CAST(matches * 2 AS DOUBLE) END AS win_rate,
    CASE WHEN label <> against THEN ((p + zz / (2e0 * n)) - half) / (1e0 + zz / n) END AS low, CASE WHEN label <> against THEN ((p + zz / (2e0 * n)) + half) / (1e0 + zz / n) END AS high
  FROM (SELECT *, CAST({z} AS DOUBLE) * sqrt((p * (1e0 - p) + zz / (4e0 * n)) / n) AS half FROM shares))
""".format(z=repr(Z), zz=repr(Z * Z))

CATALOGUE = """
, judged_cards AS (
  SELECT p.*, c.name, c.colors, lower(trim(c.name)) AS name_key, p.card_id % 9 = 0 AS two, CASE WHEN p.card_id % 9 = 0 THEN 'transform' ELSE 'normal' END AS layout,
    CASE WHEN p.printing_id % 101 = 0 THEN 'missing_oracle_id' WHEN p.card_id % 9 = 0 AND p.printing_id % 47 = 0 THEN 'missing_required_faces' END AS reason FROM printings p JOIN cards c USING (card_id)),
kept AS (SELECT * FROM judged_cards WHERE reason IS NULL)
"""

PACKAGES = """
, held AS (SELECT DISTINCT f.format, f.deck_id, c.name AS item FROM facts f JOIN cards c USING (card_id)),
sets AS (SELECT format, deck_id, [item] AS items FROM held UNION ALL SELECT s.format, s.deck_id, list_append(s.items, h.item) FROM sets s JOIN held h ON h.format = s.format AND h.deck_id = s.deck_id AND h.item > s.items[-1]),
counted AS (SELECT format, items, count(*) AS decks FROM sets WHERE len(items) >= 2 GROUP BY ALL HAVING count(*) >= 3),
run_decks AS (SELECT format, count(DISTINCT deck_id) AS n FROM held GROUP BY format),
singles AS (SELECT format, map_from_entries(list((item, CAST(c AS DOUBLE) / CAST(n AS DOUBLE)))) AS share FROM (SELECT format, item, count(*) AS c FROM held GROUP BY ALL) JOIN run_decks USING (format) GROUP BY format)
SELECT format, array_to_string(items, '|') AS items, len(items) AS size, decks, CAST(decks AS DOUBLE) / CAST(n AS DOUBLE) / list_reduce(list_transform(items, lambda x: share[x]), lambda a, b: a * b, 1e0) AS lift FROM counted JOIN run_decks USING (format) JOIN singles USING (format)"""

ARCHETYPES = """
, kinds AS (
  SELECT format, label, count(*) AS deck_count, CASE WHEN length(label) % 3 = 0 THEN count(*) + 1 ELSE count(DISTINCT event_id) END AS event_count, count(made_cut) AS cut_known, CASE WHEN length(label) % 2 <> 0 THEN sum(CAST(made_cut AS INT)) END AS cut_made,
    count(*) FILTER (known) AS record_decks FROM results WHERE label IS NOT NULL GROUP BY format, label),
twice AS (SELECT * FROM kinds UNION ALL SELECT * FROM kinds WHERE length(label) % 5 = 0),
firsts AS (SELECT *, CASE WHEN card_id % 11 = 0 THEN 'other' ELSE label END AS home, CASE WHEN card_id % 13 = 0 THEN decks + 1 ELSE decks END AS support, CASE WHEN card_id % 17 = 0 THEN 0 ELSE labels END AS told FROM top_labels WHERE place = 1)
SELECT 'repeated label' AS rule, count(*) AS violations FROM kinds WHERE length(label) % 5 = 0
UNION ALL SELECT 'label''s cut known', count(*) FROM twice WHERE (cut_made IS NULL) <> (cut_known = 0)
UNION ALL SELECT 'label''s counts', count(*) FROM twice WHERE greatest(record_decks, event_count, cut_known) > deck_count
UNION ALL SELECT 'label''s win rate known', 0
UNION ALL SELECT 'leading label', count(*) FROM firsts WHERE home <> label OR support <> decks OR told < least(labels, 3)"""


def sql(rules: str, excluded: str, earlier: str) -> dict[str, str]:
    """``earlier``: the rules of the runs before; ``runs``: a registry."""
    base = BINDING.format(rules=rules, excluded=excluded).rstrip()
    scored = base + "," + CONSTRUCTED
    before = BINDING.format(rules=earlier, excluded=excluded).rstrip() + "," + CONSTRUCTED
    moved = f"""WITH now AS ({scored} SELECT format, card_id, ranking FROM rankings), old AS ({before} SELECT format, card_id, ranking AS previous FROM rankings),
        moved AS (SELECT format, card_id, ranking, previous, previous - ranking AS moved FROM now LEFT JOIN old USING (format, card_id))"""
    out = {
        "rank_movement": moved + " SELECT * FROM moved",
        "rankings_view_counts": moved + " SELECT format, count(*) AS everything, count(*) FILTER (previous > ranking) AS risers, count(*) FILTER (previous < ranking) AS fallers FROM moved GROUP BY format",
        "cohort_exclusions": base + " SELECT event_id, format, occurred_on, coverage, reason FROM judged",
        "cohort_totals": base + """ SELECT format, n AS events, players, coalesce(d.decks, 0) AS decks, coalesce(i.decks, 0) AS incomplete_decks, coalesce(cut_known, 0) AS cut_known, cut_made, wins, losses, draws
            FROM (SELECT format, count(*) AS n, CAST(sum(players) AS BIGINT) AS players FROM events GROUP BY format) LEFT JOIN (SELECT format, count(*) AS decks FROM decks GROUP BY format) d USING (format)
            LEFT JOIN (SELECT e.format, count(*) AS decks FROM all_decks a JOIN events e USING (event_id) WHERE NOT complete GROUP BY e.format) i USING (format)
            LEFT JOIN (SELECT format, count(made_cut) AS cut_known, CAST(sum(CAST(made_cut AS INT)) AS BIGINT) AS cut_made, CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(draws) AS BIGINT) AS draws FROM standings GROUP BY format) s USING (format)""",
        "card_usage": base + " SELECT format, card_id, deck_count, event_count, copies, playsets, cut_known, cut_made, record_decks, wins, losses, draws FROM usage",
        "card_top_archetypes": base + " SELECT format, card_id, label, decks, CAST(place AS BIGINT) AS place, labels FROM top_labels WHERE place <= 3",
        "archetype_concentration": base + " SELECT format, card_id, labelled, concentration FROM concentration",
        "trend_series": base + " SELECT format, card_id, CAST(period AS BIGINT) AS period, count(*) AS decks FROM facts WHERE period BETWEEN 0 AND 11 GROUP BY ALL",
        "archetype_cores": base + """ SELECT format, label, card_id, count(*) AS decks, any_value(n) AS archetype_decks FROM facts JOIN (SELECT format, label, count(*) AS n FROM decks WHERE label IS NOT NULL AND deck_id IN (SELECT deck_id FROM listed) GROUP BY ALL) USING (format, label)
            GROUP BY format, label, card_id HAVING count(*) >= 4e-3 * CAST(any_value(n) AS DOUBLE)""",
        "commander_archetypes": base + """, named AS (SELECT deck_id, string_agg(name, ' + ' ORDER BY name) AS own FROM commanders JOIN cards USING (card_id) GROUP BY deck_id),
            arch AS (SELECT format, coalesce(label, own) AS archetype, count(*) AS decks FROM decks LEFT JOIN named USING (deck_id) GROUP BY ALL)
            SELECT format, archetype, decks, rank() OVER (PARTITION BY format ORDER BY decks DESC) AS ranking FROM arch WHERE archetype IS NOT NULL""",
        "field_baseline": base + """ SELECT f.format, deck_count, labelled, cut_known, cut_made, record_decks, wins, losses, draws, early, late, concentration,
            (CAST(wins AS DOUBLE) + CAST(draws AS DOUBLE) / CAST(ppg AS DOUBLE)) / nullif(CAST(wins + losses + draws AS DOUBLE), 0) AS win_rate FROM field f LEFT JOIN field_concentration USING (format)""",
        "archetype_records": base + """ SELECT format, label, count(*) AS deck_count, count(made_cut) AS cut_known, CAST(sum(CAST(made_cut AS INT)) AS BIGINT) AS cut_made, count(*) FILTER (known) AS record_decks,
            CAST(coalesce(sum(wins) FILTER (known), 0) AS BIGINT) AS wins, CAST(coalesce(sum(losses) FILTER (known), 0) AS BIGINT) AS losses, CAST(coalesce(sum(draws) FILTER (known), 0) AS BIGINT) AS draws FROM results WHERE label IS NOT NULL GROUP BY ALL""",
        "card_performance": base + """ SELECT format, card_id, games, win_rate, win_rate - field_win AS win_delta, CASE WHEN win_rate IS NOT NULL THEN 196e-2 * sqrt(greatest(win_rate * (1e0 - win_rate), 0e0) / nullif(CAST(games AS DOUBLE), 0e0)) END AS win_ci95,
            cut_rate / nullif(field_cut, 0e0) AS cut_lift, CAST(late AS DOUBLE) / nullif(CAST(field_late AS DOUBLE), 0e0) - CAST(early AS DOUBLE) / nullif(CAST(field_early AS DOUBLE), 0e0) AS share_delta FROM features""",
        "score_constructed": scored + " SELECT format, card_id, score FROM constructed",
        "score_signature": base + f""", parts AS (SELECT *, (coalesce(concentration, 0e0) * (CASE WHEN concentration IS NULL THEN 0e0 ELSE CAST(labelled AS DOUBLE) END) + 1e1 * field_concentration) / ((CASE WHEN concentration IS NULL THEN 0e0 ELSE CAST(labelled AS DOUBLE) END) + 1e1) AS a,
            (CAST(home_support AS DOUBLE) + 1e1 * incidence) / (CAST(home_decks AS DOUBLE) + 1e1) - incidence AS b, {WIN.format(k='6e1')} - field_win AS c FROM features WHERE home IS NOT NULL),
            placed AS (SELECT *, {midrank('a')} AS pa, {midrank('b')} AS pb, {midrank('c')} AS pc FROM parts), mixed AS (SELECT *, {blend(('5e-1', 'pa'), ('3e-1', 'pb'), ('2e-1', 'pc'))} AS m FROM placed)
            SELECT format, card_id, 1e2 * {midrank('m')} AS score, 1e0 / a AS effective_archetypes FROM mixed""",
        "score_hidden_gem": base + f""", parts AS (SELECT *, CASE WHEN field_win <> 0 THEN {WIN.format(k='1e2')} / field_win - 1e0 END AS wl, {CUT.format(k='2e1')} - 1e0 AS cl, CAST(sum(playsets) OVER (PARTITION BY format) AS DOUBLE) / nullif(CAST(sum(deck_count) OVER (PARTITION BY format) AS DOUBLE), 0e0) AS pooled FROM features),
            gems AS (SELECT *, CASE WHEN pooled >= 5e-2 THEN {blend(('7e-1', 'wl'), ('3e-1', 'cl'))} * ((CAST(playsets AS DOUBLE) + 5e0 * pooled) / (CAST(deck_count AS DOUBLE) + 5e0)) * (CAST(event_count AS DOUBLE) / (CAST(event_count AS DOUBLE) + 2e0)) * (1e0 / (1e0 + incidence / 2e-2)) END AS gem FROM parts),
            good AS (SELECT *, CASE WHEN gem > 0 THEN gem END AS g FROM gems)
            SELECT format, card_id, CASE WHEN gem > 0 THEN 1e2 * {midrank('g')} WHEN gem <= 0 THEN 0e0 END AS score FROM good""",
        "score_max_ratio": base + " SELECT format, card_id, 1e2 * (CAST(deck_count AS DOUBLE) / CAST(max(deck_count) OVER (PARTITION BY format) AS DOUBLE)) AS score FROM usage WHERE card_id NOT IN (SELECT card_id FROM basics)",
        "score_foundation": base + " SELECT format, card_id, least(1e2, greatest(0e0, 1e2 * incidence)) AS staple, 0e0 AS buildaround, 0e0 - least(1e2, greatest(0e0, 1e2 * incidence)) AS delta, 1e2 * 35e-2 AS staple_coverage, 0e0 AS buildaround_coverage, round(least(1e2, greatest(0e0, 3e1 * (1e0 - exp(-CAST(deck_count AS DOUBLE) / 8e0)) + 25e0 * (1e0 - exp(-CAST(event_count AS DOUBLE) / 4e0)) + 1e1 * 35e-2 / 2e0)), 6) AS evidence FROM features",
        "overall_grade": scored + f""", graded AS (SELECT card_id, format, score, deck_count AS decks, CAST(deck_count AS DOUBLE) / (CAST(deck_count AS DOUBLE) + 25e1) AS w FROM constructed JOIN usage USING (format, card_id) WHERE score IS NOT NULL),
            summed AS (SELECT card_id, count(*) AS formats, CAST(sum(decks) AS BIGINT) AS decks, list_reduce(list_prepend(0e0, list(w ORDER BY format)), lambda x, y: x + y) AS evidence, list_reduce(list_prepend(0e0, list(w * score ORDER BY format)), lambda x, y: x + y) AS total FROM graded GROUP BY card_id),
            mixed2 AS (SELECT *, (total + 5e1) / (evidence + 1e0) AS m, 1 AS one FROM summed)
            SELECT card_id, formats, decks, evidence, 1e2 * {midrank('m', 'one')} AS score FROM mixed2""",
        "overall_pooled_usage": base + """ SELECT card_id, CAST(sum(deck_count) AS BIGINT) AS deck_count, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(copies) AS BIGINT) AS copies, CAST(sum(playsets) AS BIGINT) AS playsets, CAST(sum(cut_known) AS BIGINT) AS cut_known, CAST(sum(cut_made) AS BIGINT) AS cut_made,
            CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(draws) AS BIGINT) AS draws, list_reduce(list_prepend(0e0, list(CASE WHEN cut_made IS NOT NULL AND field_cut <> 0 THEN CAST(cut_known AS DOUBLE) * field_cut ELSE 0e0 END ORDER BY format)), lambda x, y: x + y) AS expected,
            CAST(sum(cut_made) FILTER (field_cut <> 0) AS DOUBLE) / nullif(list_reduce(list_prepend(0e0, list(CASE WHEN cut_made IS NOT NULL AND field_cut <> 0 THEN CAST(cut_known AS DOUBLE) * field_cut ELSE 0e0 END ORDER BY format)), lambda x, y: x + y), 0e0) AS cut_lift,
            list_reduce(list_prepend(0e0, list(coalesce((win_rate - field_win) * CAST(games AS DOUBLE), 0e0) ORDER BY format)), lambda x, y: x + y) / nullif(CAST(sum(games) FILTER (win_rate - field_win IS NOT NULL) AS DOUBLE), 0e0) AS win_delta FROM features GROUP BY card_id""",
        "rankings_page": scored + " SELECT format, card_id, score, ranking FROM rankings ORDER BY ranking, format, card_id LIMIT 25 OFFSET 10",
        "rankings_filtered_keeps_rank": scored + " SELECT r.format, card_id, r.score, r.ranking FROM rankings r JOIN cards USING (card_id) WHERE list_has_any(colors, ['U', 'R']) OR len(colors) = 0",
        "compare_formats": scored + " SELECT card_id, any_value(name) AS name, count(*) AS formats, arg_min(format, (-score, format)) AS best_format, max(score) AS best, CAST(min(ranking) AS BIGINT) AS best_ranking FROM rankings JOIN cards USING (card_id) WHERE score IS NOT NULL GROUP BY card_id",
        "compare_every": scored + " SELECT card_id, count(*) AS formats, max(score) AS best FROM rankings WHERE score IS NOT NULL GROUP BY card_id HAVING count(*) = (SELECT count(DISTINCT format) FROM rankings)",
        "grades": scored + """ SELECT format, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 80 THEN 'A-' WHEN score >= 75 THEN 'B+' WHEN score >= 70 THEN 'B' WHEN score >= 65 THEN 'B-' WHEN score >= 60 THEN 'C+' WHEN score >= 50 THEN 'C' WHEN score >= 45 THEN 'C-' WHEN score >= 35 THEN 'D' WHEN score IS NOT NULL THEN 'F' END AS grade, count(*) AS cards FROM constructed GROUP BY ALL""",
        "top_percent": scored + " SELECT format, card_id, CAST(greatest(1, ceil(100 * ranking / (count(score) OVER (PARTITION BY format)))) AS BIGINT) AS top FROM rankings QUALIFY score IS NOT NULL",
        "share_series": base + """, own AS (SELECT DISTINCT format, label, deck_id, period FROM facts WHERE label IS NOT NULL), t AS (SELECT format, period, count(*) AS total FROM own GROUP BY ALL), n AS (SELECT format, label, period, count(*) AS decks FROM own GROUP BY ALL)
            SELECT c.format, c.label, CAST(r.p AS BIGINT) AS period, CASE WHEN total IS NOT NULL THEN CAST(coalesce(decks, 0) AS DOUBLE) / CAST(total AS DOUBLE) END AS share FROM (SELECT DISTINCT format, label FROM own) c CROSS JOIN range(0, 12) r(p)
            LEFT JOIN n ON n.format = c.format AND n.label = c.label AND n.period = r.p LEFT JOIN t ON t.format = c.format AND t.period = r.p""",
        "playoff_preview": base + """ SELECT card_id, count(*) AS decks, (CAST(sum(wins) AS DOUBLE) + 1e1 * 5e-1) / (CAST(sum(wins + losses) AS DOUBLE) + 1e1) AS record FROM results JOIN deck_cards USING (deck_id) WHERE made_cut AND wins IS NOT NULL GROUP BY card_id ORDER BY decks DESC, record DESC, card_id LIMIT 10""",
        "published_deck_order": base + " SELECT format, deck_id, row_number() OVER (PARTITION BY format ORDER BY occurred_on DESC, event_id, source_ord) - 1 AS position FROM decks",
        "card_decks_page": base + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY occurred_on DESC, event_id, source_ord) - 1 AS position FROM decks)
            SELECT o.format, o.deck_id, o.position, o.event_id, copies FROM ordered o JOIN deck_cards USING (deck_id) WHERE card_id = 17 ORDER BY o.format, o.position LIMIT 20""",
        "deck_list": base + f""", shown AS (SELECT *, coalesce(type_line, array_to_string(face_types, ' // ')) AS shown FROM cards),
            zones AS (SELECT deck_id, 'main' AS zone, card_id, copies FROM deck_cards UNION ALL SELECT deck_id, 'side', card_id, copies FROM sideboards UNION ALL SELECT deck_id, 'commander', card_id, 1 FROM commanders)
            SELECT z.deck_id, zone, card_id, name, copies, {GROUP} AS deck_group FROM zones z JOIN decks USING (deck_id) LEFT JOIN shown USING (card_id)""",
        "representative_printing": base + " SELECT card_id, printing_id, set_code, language, released_on FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY language <> 'en', released_on DESC, printing_id) AS n FROM printings) WHERE n = 1",
        "original_first_preview": base + " SELECT card_id, printing_id, set_code, released_on, printings FROM originals JOIN (SELECT card_id, count(*) AS printings FROM printings GROUP BY card_id) USING (card_id) WHERE place = 1",
        "catalog_joint_printing": base + " SELECT card_id, count(*) AS eligible FROM printings WHERE set_code IN ('S1', 'pS2') AND rarity IN ('rare', 'mythic') AND list_contains(games, 'paper') GROUP BY card_id",
        "catalog_keyset_page": base + " SELECT lower(name) AS name_key, card_id FROM cards WHERE lower(name) > 'blue' OR (lower(name) = 'blue' AND card_id > 5) ORDER BY 1, 2 LIMIT 26",
        "printing_keyset_page": base + " SELECT printing_id, set_code, released_on, collector_number FROM originals WHERE card_id = 17 AND place > 3 ORDER BY place LIMIT 11",
        "cheapest_price": base + " SELECT card_id, usd, printing_id FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY usd, printing_id) AS n FROM offers WHERE usd > 0) WHERE n = 1",
        "score_per_dollar": scored + " SELECT format, card_id, score / CAST(min(usd) AS DOUBLE) AS per_dollar FROM constructed JOIN offers USING (card_id) WHERE usd > 0 GROUP BY format, card_id, score",
        "color_overlap": base + " SELECT card_id, array_to_string(colors, '') AS colors FROM cards WHERE list_has_any(colors, ['W', 'G'])",
        "color_identity_subset": base + " SELECT card_id, array_to_string(colors, '') AS colors FROM cards WHERE colors IS NOT NULL AND len(list_filter(colors, lambda x: x NOT IN ('W', 'U'))) = 0",
        "name_search": base + " SELECT card_id, name FROM cards WHERE contains(lower(name), 'ring')",
        "modal_names": base + " SELECT type_line, name FROM (SELECT type_line, name, row_number() OVER (PARTITION BY type_line ORDER BY count(*) DESC, name) AS n FROM cards GROUP BY type_line, name) WHERE n = 1",
        "coverage_classes": base + " SELECT event_id, CASE WHEN players <= 0 THEN 'UNKNOWN' WHEN decklists <= 0 THEN 'NONE' WHEN decklists < players THEN 'PARTIAL' ELSE 'FULL_FIELD' END AS class FROM all_events",
        "top_cut_inference": base + """, rows AS (SELECT event_id, deck_id, row_number() OVER (PARTITION BY event_id ORDER BY wins DESC NULLS LAST, deck_id) - 1 AS position, CASE WHEN event_id < 'E' OR deck_id % 3 <> 0 THEN coalesce(wins, 0) END AS wins, CAST(ascii(substr(event_id, 1, 1)) % 3 * 4 AS INT) AS size, CASE WHEN event_id > 'M' THEN deck_id % 3 END AS bw, CASE WHEN event_id > 'M' THEN 0 END AS bl FROM all_standings),
            per AS (SELECT event_id, any_value(size) AS size, count(*) AS n, count(bw) AS b, count(wins) AS w, min(wins) FILTER (position < size) AS lo, max(wins) FILTER (position >= size) AS hi FROM rows GROUP BY event_id),
            based AS (SELECT event_id, CASE WHEN size = 0 THEN 'no_top_cut' WHEN b = n THEN 'bracket_record' WHEN w < n OR (n > size AND lo < hi) THEN 'inconsistent_order' ELSE 'standing_order' END AS basis FROM per)
            SELECT basis, CASE WHEN basis = 'bracket_record' THEN bw + bl > 0 WHEN basis = 'standing_order' THEN position < size END AS made_cut, count(*) AS n FROM rows JOIN based USING (event_id) GROUP BY ALL""",
        "resolution_weighted": base + """ SELECT event_id, count(*) AS lines, count(c) AS resolved_lines, CAST(sum(copies) AS BIGINT) AS copies, CAST(coalesce(sum(copies) FILTER (c IS NOT NULL), 0) AS BIGINT) AS resolved_copies, CAST(count(c) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS line_share, CAST(coalesce(sum(copies) FILTER (c IS NOT NULL), 0) AS DOUBLE) / CAST(sum(copies) AS DOUBLE) AS copy_share
            FROM (SELECT event_id, copies, CASE WHEN card_id % 10 <> 0 THEN card_id END AS c FROM all_decks JOIN deck_cards USING (deck_id)) GROUP BY event_id""",
        "validation_violations": base + """ SELECT 'events' AS rule, count(*) AS violations FROM all_events WHERE decklists > players UNION ALL SELECT 'copies', count(*) FROM deck_cards WHERE copies NOT BETWEEN 1 AND 3 UNION ALL SELECT 'orphans', count(*) FROM printings WHERE card_id NOT IN (SELECT card_id FROM cards)
            UNION ALL SELECT 'labels', count(*) FROM all_decks WHERE label IS NULL UNION ALL SELECT 'recount', count(*) FROM usage WHERE cut_made > cut_known""",
        "cooccurrence_lift": base + """, c AS (SELECT format, card_id, count(*) AS n FROM facts GROUP BY ALL), f AS (SELECT format, count(DISTINCT deck_id) AS n FROM facts GROUP BY format)
            SELECT p.*, CAST(together AS DOUBLE) * CAST(f.n AS DOUBLE) / CAST(x.n * y.n AS DOUBLE) AS lift FROM (SELECT l.format, l.card_id AS a, r.card_id AS b, count(*) AS together FROM facts l JOIN facts r ON l.deck_id = r.deck_id AND l.card_id < r.card_id GROUP BY ALL HAVING count(*) >= 2) p
            JOIN c x ON x.format = p.format AND x.card_id = a JOIN c y ON y.format = p.format AND y.card_id = b JOIN f ON f.format = p.format""",
        "collector_order": base + " SELECT card_id, printing_id, row_number() OVER (PARTITION BY card_id ORDER BY coalesce(try_cast(regexp_extract(collector_number, '^[0-9]+') AS DOUBLE), CAST('NaN' AS DOUBLE)), collector_number, printing_id) AS place FROM printings",
        "printing_summary": base + " SELECT count(*) AS printings, count(DISTINCT card_id) AS cards, min(released_on) AS first, max(released_on) AS last, string_agg(DISTINCT set_code, ',' ORDER BY set_code) AS sets FROM printings",
        "unplayed_cards": base + " SELECT card_id FROM cards WHERE card_id NOT IN (SELECT card_id FROM facts)",
        "unscored_cards": base + " SELECT format, card_id, deck_count FROM usage WHERE card_id IN (SELECT card_id FROM basics)",
        "rankings_min_decks": scored + " SELECT format, card_id, deck_count, ranking FROM rankings JOIN usage USING (format, card_id) WHERE deck_count >= 5",
        "compare_by_run": scored + """ SELECT card_id, name, chosen, runs FROM (SELECT card_id, max(score) FILTER (format = 'ASIA') AS chosen, string_agg(format || ':' || CAST(ranking AS VARCHAR), ',' ORDER BY format) AS runs FROM rankings GROUP BY card_id) JOIN cards USING (card_id) ORDER BY chosen DESC NULLS LAST, card_id LIMIT 25""",
        "overall_components": scored + " SELECT format, weight, count(score) AS scored, max(score) AS best FROM constructed JOIN (VALUES ('ASIA', 1e0), ('EUROPE', 5e-1), ('NOWHERE', 2e0)) AS c(format, weight) USING (format) GROUP BY ALL",
        "version_union": base + " SELECT format, string_agg(DISTINCT 'v' || CAST(deck_id % 3 AS VARCHAR), '+' ORDER BY 'v' || CAST(deck_id % 3 AS VARCHAR)) AS version FROM decks GROUP BY format",
        "score_completeness": base + """ SELECT format, 2 * n AS expected, given, 2 * n = given AS complete FROM (SELECT format, count(*) AS n FROM usage WHERE card_id NOT IN (SELECT card_id FROM basics) GROUP BY format)
            LEFT JOIN (SELECT format, 2 * count(*) AS given FROM features WHERE home IS NOT NULL GROUP BY format) USING (format)""",
        "deck_headers": base + " SELECT format, deck_id, event_id, occurred_on, label, made_cut, CASE WHEN known THEN wins END AS wins, CASE WHEN known THEN losses END AS losses, CASE WHEN known THEN draws END AS draws FROM results",
        "deck_mainboards": base + " SELECT deck_id, string_agg(CAST(card_id AS VARCHAR), ',' ORDER BY card_id) AS cards FROM deck_cards GROUP BY deck_id",
        "event_projection": base + " SELECT event_id, occurred_on, format, players, decklists, CAST(decklists AS DOUBLE) / nullif(CAST(players AS DOUBLE), 0) AS coverage, CASE WHEN players <= 0 THEN 'UNKNOWN' WHEN decklists <= 0 THEN 'NONE' WHEN decklists < players THEN 'PARTIAL' ELSE 'FULL_FIELD' END AS class FROM all_events",
        "deck_zones": "SELECT deck_id, zone, count(*) FILTER (ok) AS cards, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS copies, count(*) FILTER (NOT ok) AS skipped FROM (SELECT l_orderkey AS deck_id, CASE WHEN l_returnflag = 'R' THEN 'side' ELSE 'main' END AS zone, CAST(floor(l_quantity) AS INT) % 5 AS n, l_partkey % 50 <> 0 AND CAST(floor(l_quantity) AS INT) % 5 > 0 AS ok FROM lineitem) GROUP BY deck_id, zone",
        "score_run_violations": scored + ", run AS (SELECT * FROM features), scores AS (SELECT * FROM constructed) " + violations(RUN_RULES),
        "score_run_seeded": scored + """, seeded AS (SELECT * REPLACE (CASE WHEN card_id % 7 <> 0 THEN cut_made END AS cut_made, CASE WHEN card_id % 5 <> 0 THEN home END AS home, CASE WHEN card_id % 11 = 0 THEN deck_count + 1 ELSE record_decks END AS record_decks, CASE WHEN card_id % 13 <> 0 THEN win_rate END AS win_rate,
            CASE WHEN card_id % 17 = 0 THEN deck_count + 2 ELSE event_count END AS event_count, CASE WHEN card_id % 19 = 0 THEN deck_count + 1 ELSE labelled END AS labelled) FROM features), run AS (SELECT * FROM seeded UNION ALL SELECT * FROM seeded WHERE card_id % 37 = 0),
            off AS (SELECT format, CASE WHEN card_id % 29 = 0 THEN card_id + 1000000 ELSE card_id END AS card_id, score FROM constructed WHERE card_id % 23 <> 0), nans AS (SELECT format, card_id, CASE WHEN card_id % 31 = 0 THEN CAST('NaN' AS DOUBLE) ELSE score END AS score FROM off), scores AS (SELECT * FROM nans UNION ALL SELECT * FROM nans WHERE card_id % 41 = 0) """ + violations(RUN_RULES),
        "overall_run_violations": scored + """, pooled AS (SELECT card_id, sum(deck_count) AS n, sum(event_count) AS e, CASE WHEN card_id % 9 = 0 THEN 0 ELSE sum(copies) END AS c, sum(cut_known) AS k, sum(cut_made) AS m FROM features GROUP BY card_id),
            comps AS (SELECT format FROM rules WHERE format <> 'ASIA'), given AS (SELECT DISTINCT card_id FROM features WHERE card_id % 8 <> 0) """ + violations({
            "repeated component": "FROM (SELECT 1 FROM comps GROUP BY format HAVING count(*) > 1)", "own component": "FROM comps WHERE format = 'OVERALL'", "repeated card": "FROM (SELECT 1 FROM pooled GROUP BY card_id HAVING count(*) > 1)",
            "cut known": "FROM pooled WHERE (m IS NULL) <> (k = 0)", "counts": "FROM pooled WHERE e > n OR k > n OR c < n", "no component": "FROM constructed ANTI JOIN comps USING (format) WHERE score IS NOT NULL",
            "unscored card": "FROM pooled ANTI JOIN given USING (card_id)", "unknown card": "FROM given ANTI JOIN pooled USING (card_id)", "repeated score": "FROM (SELECT 1 FROM given GROUP BY card_id HAVING count(*) > 1)", "not finite": "FROM given WHERE false",
        }),
        "search_type": base + " SELECT card_id FROM cards WHERE contains(lower(type_line), 'sorc') OR len(list_filter(face_types, lambda x: contains(lower(x), 'sorc'))) > 0",
        "search_text": base + " SELECT card_id FROM cards WHERE contains(lower(oracle_text), 'brand#1') OR len(list_filter(face_texts, lambda x: contains(lower(x), 'brand#1'))) > 0",
        "search_everywhere": base + " SELECT card_id FROM cards WHERE contains(lower(name), 'ar') OR contains(lower(type_line), 'ar') OR contains(lower(oracle_text), 'ar') OR len(list_filter(face_types, lambda x: contains(lower(x), 'ar'))) > 0 OR len(list_filter(face_texts, lambda x: contains(lower(x), 'ar'))) > 0",
        "event_windows": "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL",
    }
    out["saved_event_facts"] = pages.SQL
    fits = "set_code IN ('S1', 'pS2') AND rarity IN ('rare', 'mythic') AND list_contains(games, 'paper')"
    out["joint_with_preview"] = base + f" SELECT card_id, count(*) FILTER (fits) AS eligible, count(*) AS printings, min_by(printing_id, place) FILTER (fits) AS preview FROM (SELECT o.card_id, o.printing_id, place, {fits} AS fits FROM originals o) GROUP BY card_id HAVING count(*) FILTER (fits) > 0"
    out["joint_printing_page"] = base + " SELECT printing_id, set_code, released_on FROM (SELECT * FROM originals WHERE card_id = 17 AND set_code IN ('S0', 'S1', 'S2') AND list_contains(games, 'paper')) ORDER BY place LIMIT 3"
    out["type_regex_filter"] = base + " SELECT card_id, shown AS type_line FROM (SELECT card_id, coalesce(type_line, array_to_string(face_types, ' // ')) AS shown FROM cards) WHERE regexp_matches(shown, '(^|//)[^—/]*\\bLand\\b')"
    out["run_windows"] = base + RUNS + " SELECT DISTINCT ON (source, format, starts_on, ends_before) source, format, starts_on, ends_before, run_id FROM runs ORDER BY source, format, starts_on, ends_before, active DESC, made DESC, run_id"
    out["previous_run"] = base + RUNS + " SELECT run_id, previous_id FROM earlier"
    recursive = base.replace("WITH", "WITH RECURSIVE", 1)
    out["run_chain"] = recursive + RUNS + ", walk AS (SELECT run_id, previous_id AS earlier_id, 1 AS steps FROM earlier WHERE previous_id IS NOT NULL UNION ALL SELECT w.run_id, e.previous_id, steps + 1 FROM walk w JOIN earlier e ON e.run_id = w.earlier_id WHERE e.previous_id IS NOT NULL) SELECT run_id, earlier_id, CAST(steps AS BIGINT) AS steps FROM walk"
    out["matchup_matrix"] = base + MATCHUPS + " SELECT format, label, against, matches, wins, losses, draws, win_rate, low, high FROM cells"
    out["matchup_table"] = base + MATCHUPS + " SELECT format, label, " + ", ".join(f"max(win_rate) FILTER (against = '{x}') AS \"{x}\"" for x in ("BUILDING", "FURNITURE", "MACHINERY")) + " FROM cells GROUP BY format, label"
    out["card_packages"] = recursive + PACKAGES
    out["price_as_of"] = base + ", told AS (SELECT l_partkey AS card_id, CAST(l_shipdate AS DATE) AS day, min(CAST(floor(l_extendedprice) AS BIGINT)) AS price FROM lineitem GROUP BY ALL) SELECT f.format, f.deck_id, f.card_id, f.occurred_on AS day, t.price, t.day AS since FROM facts f ASOF LEFT JOIN told t ON f.card_id = t.card_id AND f.occurred_on >= t.day"
    out["export_digests"] = base + """, lines AS (SELECT row_number() OVER (ORDER BY name, card_id) - 1 AS i, '{"card_id":' || card_id || ',"name":"' || name || '"}' || chr(10) AS line FROM cards)
      SELECT part, count(*) AS rows, CAST(sum(strlen(line)) AS BIGINT) AS bytes, sha256(string_agg(line, '' ORDER BY i)) AS sha256 FROM (SELECT *, i // 500 AS part FROM lines) GROUP BY part"""
    out["stream_places"] = """WITH counts AS (SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events FROM events GROUP BY ALL),
      placed AS (SELECT CAST(day AS TIMESTAMP) AS day, event_type, events, rank() OVER (PARTITION BY day ORDER BY events DESC) AS place, dense_rank() OVER (ORDER BY day) AS n FROM counts)
      SELECT p.day, p.event_type, p.events, p.place, o.place - p.place AS moved FROM placed p LEFT JOIN placed o ON o.n = p.n - 1 AND o.event_type = p.event_type WHERE p.day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""
    ordered = "row_number() OVER (PARTITION BY format ORDER BY occurred_on DESC, event_id, source_ord) - 1 AS position"
    out["deck_headers_full"] = base + f""", side AS (SELECT deck_id, string_agg(CAST(card_id AS VARCHAR), ',' ORDER BY card_id) AS sideboard FROM (SELECT DISTINCT l_orderkey AS deck_id, l_partkey AS card_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber > 3) GROUP BY deck_id),
      apart AS (SELECT deck_id, string_agg(CAST(card_id AS VARCHAR), ',' ORDER BY pos) AS commanders FROM commanders GROUP BY deck_id)
      SELECT format, position, deck_id, event_id, made_cut, CASE WHEN known THEN wins END AS wins, CASE WHEN known THEN losses END AS losses, CASE WHEN known THEN draws END AS draws, coalesce(commanders, '') AS commanders, coalesce(sideboard, '') AS sideboard
      FROM (SELECT *, {ordered} FROM results) LEFT JOIN apart USING (deck_id) LEFT JOIN side USING (deck_id)"""
    out["commander_spellings"] = base + """, heads AS (SELECT d.format, c.deck_id, c.card_id FROM commanders c JOIN decks d USING (deck_id) WHERE d.label IS NULL),
      seen AS (SELECT d.format, l.card_id, CASE WHEN l.deck_id % 3 = 0 THEN c.name || ' // Back' ELSE c.name END AS name FROM deck_cards l JOIN decks d USING (deck_id) JOIN cards c USING (card_id)),
      spelled AS (SELECT format, card_id, name FROM (SELECT format, card_id, name, row_number() OVER (PARTITION BY format, card_id ORDER BY count(*) DESC, name) AS n FROM seen GROUP BY format, card_id, name) WHERE n = 1),
      named AS (SELECT deck_id, string_agg(name, ' + ' ORDER BY name) AS led_by FROM heads JOIN spelled USING (format, card_id) GROUP BY deck_id)
      SELECT format, archetype, count(*) AS decks FROM (SELECT d.format, coalesce(label, led_by) AS archetype FROM decks d LEFT JOIN named USING (deck_id)) WHERE archetype IS NOT NULL GROUP BY ALL"""
    out["catalogue_outputs"] = base + CATALOGUE + """ SELECT CAST(card_id AS VARCHAR) AS card_id, CAST(printing_id AS VARCHAR) AS source_id, name_key, layout, CASE WHEN two THEN CASE WHEN printing_id % 2 = 0 THEN 'WG' END ELSE array_to_string(colors, '') END AS colors, printings,
        CAST(CASE WHEN two THEN printings * 2 ELSE 0 END AS BIGINT) AS pictures, CAST(CASE WHEN two THEN 3 ELSE 1 END AS BIGINT) AS aliases, CAST(CASE WHEN two THEN 2 ELSE 0 END AS BIGINT) AS faces
      FROM (SELECT *, row_number() OVER (PARTITION BY card_id ORDER BY language <> 'en', released_on DESC NULLS LAST, CAST(printing_id AS VARCHAR)) AS n, count(*) OVER (PARTITION BY card_id) AS printings FROM kept) WHERE n = 1"""
    out["catalogue_exclusions"] = base + CATALOGUE + " SELECT reason, CAST(sum(CASE WHEN printing_id % 10 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS cards FROM judged_cards WHERE reason IS NOT NULL GROUP BY reason"
    out["method_runs_seeded"] = base + """, m AS (SELECT format, card_id, method, card_id % 7 <> 0 AS own, method = 'signature' AS two, card_id % 11 = 0 AS more, method = 'constructed' OR home IS NOT NULL AS rated FROM features CROSS JOIN (VALUES ('constructed'), ('signature')) AS t(method)),
      g AS (SELECT *, CASE WHEN card_id % 17 = 0 THEN 0 ELSE CAST(own AND rated AS INT) + CAST(two AND rated AS INT) + CAST(more AS INT) END AS n FROM m)
      SELECT 'repeated method' AS rule, 0 AS violations UNION ALL SELECT 'unscored card of a method', count(*) FROM g WHERE n = 0 UNION ALL SELECT 'card without a method''s run', 0
      UNION ALL SELECT 'declared outputs', count(*) FROM g WHERE n > 0 AND (more OR NOT own OR NOT rated) UNION ALL SELECT 'output twice', 0 UNION ALL SELECT 'output not finite', CAST(coalesce(sum(n), 0) AS BIGINT) FROM g WHERE card_id % 13 = 0
      UNION ALL SELECT 'scored cards', count(*) FROM (SELECT DISTINCT format FROM features WHERE format = 'ASIA')"""
    out["cohort_cube"] = base + " SELECT format, label, made_cut, GROUPING(format, label, made_cut) AS \"grouping\", count(*) AS decks, CAST(sum(wins) AS BIGINT) AS wins FROM results GROUP BY CUBE (format, label, made_cut)"
    out["cohort_rollup"] = base + " SELECT format, event_id, GROUPING(format, event_id) AS \"grouping\", count(*) AS decks, count(label) AS labelled FROM results GROUP BY ROLLUP (format, event_id)"
    out["usage_sketches"] = base + " SELECT format, card_id, count(*) AS decks, true AS players_close, true AS median_close FROM facts WHERE format = 'ASIA' AND occurred_on >= DATE '1997-04-01' AND occurred_on < DATE '1997-10-01' GROUP BY format, card_id"
    out["deck_recount_violations"] = base + recount_sql(False)
    out["deck_recount_seeded"] = base + recount_sql(True)
    out["archetype_violations"] = base + ARCHETYPES
    return {name: " ".join(text.split()) if name != "type_regex_filter" else text for name, text in out.items()}
