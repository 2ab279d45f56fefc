"""SQL counterparts of the operators' queries, where SQL can express them, by comparing everything with everything.

The trained scores (3, 9, 10), the tokenizer (4, 6), an approximate search (1) and the hash of (8) have none.  The
repair of conversations (13) is the same choice in other terms: text that begins with a cost of twelve digits, folded
over the rows from the last one."""

from __future__ import annotations

_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(text="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, w.doc_id) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) USING (doc_id)"""

_ITEM_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS.format(text="coalesce(text, '')")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s FROM items WHERE len(w) > 0),
words AS (SELECT doc_id, {_ITEM_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
placed AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words CROSS JOIN (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, p.size FROM placed p JOIN windows USING (s)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

SUFFIX_DEDUP = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, k, substr(h, 1000 * k + 1, 1098) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 1000 + 1)) AS k FROM raw)),
bytes AS (SELECT doc_id, 500 * k + j AS i, substr(h, 2 * j - 1, 2) AS x, substr(h, 2 * j - 1, 100) AS s FROM (SELECT doc_id, k, h, unnest(range(1, least(len(h) // 2, 500) + 1)) AS j FROM blocks)),
starts AS (SELECT doc_id, i, s FROM bytes WHERE len(s) = 100),
first AS (SELECT s, min(doc_id) AS least FROM starts GROUP BY s),
lost AS (SELECT doc_id, i, least < doc_id AS gone FROM starts JOIN first USING (s)),
judged AS (
  SELECT b.doc_id, b.i, x, coalesce(bool_or(coalesce(gone, false)) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS removed
  FROM bytes b LEFT JOIN lost l ON l.doc_id = b.doc_id AND l.i = b.i),
edges AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM judged),
kept AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY i) FILTER (NOT removed) AS h FROM edges GROUP BY doc_id)
SELECT doc_id, len(raw.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)"""


_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS entries)"


def _crc32(text: str) -> str:
    """crc32 of ASCII text, from the table in ``crc``."""
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


_TURN_DIGEST = "sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)"

PREFIX_TRIE = f"""
WITH {_CRC_TABLE},
turns AS (SELECT conv_id, turn, role, text, {_TURN_DIGEST} AS digest FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY conv_id),
heads AS (SELECT conv_id, t, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM convs, crc),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:h], []), c.t[h + 1:]) AS t FROM heads c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (SELECT conv_id, d, t[1:d] AS k, len(t) = d AS ends FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
below AS (SELECT k[1:e] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM own) GROUP BY 1)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN below USING (k) LEFT JOIN nodes p ON o.d > 0 AND p.k = o.k[1:o.d - 1]"""

THRESHOLD_SEARCH = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


def _taken(letter: str, cost: str, way: str) -> str:
    return f"CASE WHEN {way} = '~' THEN '~' ELSE lpad(CAST(CAST(left({way}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || '{letter}' || substr({way}, 13) END"


def _inserted(ways: str, of: str = "x") -> str:
    """Two rounds of inserting a turn before what follows; the states are start, system, user, assistant."""
    for name in (of + "1", of + "2"):
        user, assistant = _taken("I", "3", f"{name}[3]"), _taken("I", "3", f"{name}[4]")
        ways = f"list_transform([{ways}], lambda {name}: [least({name}[1], {user}), least({name}[2], {user}), least({name}[3], {assistant}), least({name}[4], {user})])[1]"
    return ways


def _edited() -> str:
    """Ways in front of a row of code c."""
    extra = "(CASE WHEN upper(c) = c THEN 3 ELSE 0 END)"

    def stay(role: str, to: int) -> str:
        return f"CASE WHEN c = 'x' THEN '~' WHEN lower(c) = '{role}' THEN {_taken('K', extra, f'w[{to}]')} ELSE {_taken('R', f'3 + {extra}', f'w[{to}]')} END"

    gone = [_taken("D", "4", f"w[{i}]") for i in range(1, 5)]
    system = f"CASE WHEN lower(c) = 's' THEN {_taken('K', extra, 'w[2]')} ELSE '~' END"
    return f"[least({gone[0]}, {system}, {stay('u', 3)}), least({gone[1]}, {stay('u', 3)}), least({gone[2]}, {stay('a', 4)}), least({gone[3]}, {stay('u', 3)})]"


STRUCTURE_REPAIR = f"""
WITH RECURSIVE {_CRC_TABLE},
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, fault = 0 AS lost, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lost ORDER BY turn NULLS FIRST, {_TURN_DIGEST}, copy) AS i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, lost, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id, lost ORDER BY i) || initial AS pair FROM placed),
convs AS (
  SELECT conv_id, coalesce(max(turn) FILTER (NOT lost) - min(turn) FILTER (NOT lost) + 1 - count(DISTINCT turn) FILTER (NOT lost), 0) AS gaps,
    count(*) FILTER (NOT lost AND fault = 'blank') AS blank, count(*) FILTER (NOT lost AND fault = 'duplicate') AS duplicate, count(*) FILTER (NOT lost AND fault = 'truncated') AS truncated,
    count(*) FILTER (NOT lost AND pair NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(list(CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END ORDER BY i) FILTER (NOT lost), []) AS codes,
    list(role ORDER BY i) FILTER (NOT lost) AS roles, list(text ORDER BY i) FILTER (NOT lost) AS texts
  FROM judged GROUP BY conv_id),
solved AS (
  SELECT *, CASE WHEN len(codes) = 0 THEN '000000000000' ELSE (list_reduce(list_reverse(codes), lambda w, c: {_inserted(_edited())}, {_inserted("['000000000000', '~', '~', '000000000000']", "y")}))[1] END AS way FROM convs),
walk AS (
  SELECT conv_id, substr(way, 13) AS audit, roles, texts, 0 AS i, '' AS last, CAST([] AS VARCHAR[]) AS lines FROM solved
  UNION ALL
  SELECT conv_id, substr(audit, 2), roles, texts, i + CASE WHEN left(audit, 1) = 'I' THEN 0 ELSE 1 END, CASE WHEN left(audit, 1) = 'D' THEN last ELSE left(line, 1) END, CASE WHEN left(audit, 1) = 'D' THEN lines ELSE list_append(lines, line) END
  FROM (SELECT *, CASE WHEN left(audit, 1) = 'K' THEN roles[i + 1] WHEN last = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN left(audit, 1) = 'I' THEN '' ELSE texts[i + 1] END AS line FROM walk WHERE audit <> ''))
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(left(way, 12) AS BIGINT) AS cost, substr(way, 13) AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM solved s JOIN walk w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.audit = ''"""


def sql() -> dict[str, str]:
    found = {
        "op2_ngram_jaccard": JACCARD, "op5_fm_index": DECONTAMINATION, "op7_suffix_dedup": SUFFIX_DEDUP, "op11_prefix_trie": PREFIX_TRIE, "op12_threshold_search": THRESHOLD_SEARCH,
        "op13_structure_repair": STRUCTURE_REPAIR,
    }
    return {name: " ".join(text.split()) for name, text in found.items()}
