"""Prefix trie, exact top-k and conversation repair against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckwright.llm import repair, threshold, trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, digest string, words long, h int, base string, copy int, code string, part int, name string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z", 4, "n", "p") for r in rows], CONVERSATIONS)


def conversations(seed: int = 5, n: int = 130) -> list[tuple]:
    """Hot openings and copies, gaps, nulls, blank and repeated turns, and one long conversation."""
    r = random.Random(seed)
    texts = ["Hello there.", "What is this?", "Nothing ends here", "", "  \n", "Ja!", None, "a b  c\td", "é."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, ""]
    rows = []
    for c in r.sample(range(-40, 400), n):
        size = r.choice([1, 1, 2, 3, 4, 5, 8])
        hot = r.random() < 0.4
        for t in range(size):
            if hot:
                rows.append((c, t, ("user", "assistant")[t % 2], f"Same {t // 3}."))
            elif r.random() < 0.9:
                rows.append((c, r.choice([t, t, t, t + 7]), r.choice(roles), r.choice(texts)))
    for t in range(70):
        rows.append((1000, t, r.choice(("user", "assistant")), "Same 0." if t < 2 else f"{t}."))
    for c in (1001, 1002):  # equal but for their ends, over the blocks of columns
        rows += [(c, t, "user", "Again.") for t in range(32 + (c == 1002))]
    rows += [(7, None, "user", "first"), (7, None, None, None)]
    return sorted(set(rows), key=repr)


# prefix trie


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((t is not None, t or 0), digest, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def nodes(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {x: 0 for x in members}
    for x in members:
        if x:
            kids[x[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for x, m in members.items():
        own = (len(m) - 1) * len(re.findall(trie.WORDS, x[-1][1])) if x else 0
        for d in range(len(x) + 1):
            leaves[x[:d]] += kids[x] == 0
            saved[x[:d]] += own
    ends = lambda x, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(x)).encode()).hexdigest()
    return {(min(m), len(x), min(members[x[:-1]]) if x else None, len(m), kids[x], leaves[x], saved[x], ends(x, m)) for x, m in members.items()}


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shard_bytes,shard_paths,last", [(4_000_000, 16, 64), (200, 2, 3), (64, 3, 4), (3000, 2, 2)])
def test_trie_against_brute_force(spark, monkeypatch, shard_bytes, shard_paths, last):
    for name, value in (("SHARD_BYTES", shard_bytes), ("SHARD_PATHS", shard_paths), ("LAST_PATHS", last), ("LAST_BYTES", 0 if last < 64 else trie.LAST_BYTES), ("ID_BLOCK", 16)):
        monkeypatch.setattr(trie, name, value)
    rows = conversations() + [(None, 0, "user", "no id")]
    got = trie.trie(trie.with_shared_heads(trie.turns(frame(spark, rows).repartition(3)), 20, 4))
    want = nodes(rebuilt(rows))
    assert sorted(map(tuple, got.select(NODE).collect()), key=str) == sorted(want, key=str) and len(want) > 200


@pytest.mark.parametrize("rounds_of", [2, 3, 5, 9])
def test_shards_recombine(rounds_of):
    """Any cut of sorted paths into shards, handed on again and again, gives the nodes of one shard."""
    r = random.Random(rounds_of)
    digest = lambda x: hashlib.sha256(str(x).encode()).digest()
    paths = sorted({tuple(digest(r.randrange(3)) for _ in range(r.choice([0, 1, 2, 3, 5, 33, 40]))) for _ in range(120)})
    rows = []
    for i, p in enumerate(paths):
        zeros = [0] * (len(p) + 1)
        rows.append({"path": b"".join(p), "words": [0, *(x[0] for x in p)], "members": [*zeros[1:], 1 + i % 3], "least": [trie.FAR] * len(p) + [i * 7 % 120], "kids": zeros, "leaves": zeros, "saved": zeros, "ends": [None] * len(p) + [f"e{i}"]})

    def shard(part, last):
        offset = np.cumsum([0, *(len(x["words"]) for x in part)])
        cells = {c: np.array([v for x in part for v in x[c]], np.int64) for c in trie.NUMBERS}
        return trie.Shard([x["path"] for x in part], cells, [v for x in part for v in x["ends"]], offset, last)

    def flat(columns):
        return list(zip(*(c.to_pylist() for c in columns), strict=True))

    shuffled = r.sample(rows, len(rows))  # a shard orders its own paths
    whole = flat(shard(shuffled, True).nodes(False))
    found, keys, first = [], {}, True
    while True:
        last = len(rows) <= 8
        step = len(rows) if last else rounds_of
        handed = []
        for a in range(0, len(rows), step):
            part = shard(r.sample(rows[a : a + step], len(rows[a : a + step])), last)
            made = flat(part.nodes(not first))
            found += made
            keys |= {x[0]: x[2] for x in made if x[0]}
            handed += part.handed_on()
        if last:
            break
        if not first and len(handed) >= len(rows):
            rounds_of *= 2
        first, rows = False, handed
    assert sorted((x[2], x[3], x[4] if x[1] is None else keys[x[1]], *x[5:]) for x in found if x[3]) == sorted((x[2:]) for x in whole if x[3])
    assert [x[2:] for x in found if not x[3]] == [x[2:] for x in whole if not x[3]]


def test_trie_of_nothing(spark):
    assert trie.trie(trie.turns(frame(spark, []))).count() == 0


# exact top-k


def test_top_k_against_every_pair(spark, monkeypatch):
    monkeypatch.setattr(threshold, "SHARD_VECTORS", 40)
    monkeypatch.setattr(threshold, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(threshold, "SAMPLE_ROWS", 25)
    r = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in r.normal(size=6).round(2)]) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(50, rows[50][1]), (50, rows[51][1])]  # hot, and repeated ids
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, rows[0][1]), (350, [0.0] * 6), (400, [0.5, 0.5]), (401, [0.25, 1.0]), (450, []), (451, [])]
    table = spark.createDataFrame([(i, x, "v", 1, 2, 3.5) for i, x in rows], "vec_id long, embedding array<double>, vector string, rep int, asked int, floor double").repartition(4)
    got = threshold.search(table, table.where(F.col("vec_id") % 50 == 0), 5)
    usable = [(i, tuple(int(np.floor(256 * c)) for c in x)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    want = []
    for q in sorted({i for i, _ in usable if i % 50 == 0}):
        best: dict[int, int] = {}
        for (i, x), (j, y) in itertools.product([v for v in usable if v[0] == q], usable):
            if j != q and len(x) == len(y):
                best[j] = max(best.get(j, -(10**18)), sum(a * b for a, b in zip(x, y, strict=True)))
        want += [(q, n, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda v: (-v[1], v[0]))[:5], 1)]
    assert sorted(map(tuple, got.collect())) == want and {x[0] for x in want} >= {0, 50, 350, 400, 450, 1000}


def test_threshold_algorithm_stops_early_and_exactly():
    r = np.random.default_rng(4)
    rows = np.floor(256 * r.exponential(size=(3000, 4)) ** 3).astype(np.int64)
    lists, met = threshold.Lists(rows), 0
    for query in [*rows[:20], -rows[5], np.zeros(4, np.int64), np.array([0, 3, 0, -1])]:
        near, score = lists.best(query, 6)
        every = rows @ query
        kth = np.sort(every)[-6]
        assert (rows[near] @ query == score).all() and set(np.flatnonzero(every >= kth)) <= set(near)
        assert len(lists.best(query, 6, kth + 1)[0]) == (every >= kth + 1).sum()
    walked = threshold.products

    def counted(rows, query):
        nonlocal met
        met += len(rows)
        return walked(rows, query)

    threshold.products = counted
    try:
        lists.best(rows[7], 6)
    finally:
        threshold.products = walked
    assert met < 1500  # of 3,000
    with pytest.raises(ValueError):
        threshold.products(np.full((1, 2), 2**40), np.full(2, 2**40))


# repair


def least_way(codes: str, most: int) -> tuple[int, str]:
    """By a search over all edits in order of cost, then letters."""
    import heapq

    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if best and (cost, audit) >= best:
            break
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", roles):
            best = (cost, audit)
            break
        if not re.fullmatch("(s?(ua)*u?)?", roles) or len(roles) > most:
            continue
        if i < len(codes):
            code = codes[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if code != "x":
                extra = 3 if code.isupper() else 0
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + code.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, roles + role))
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role))
    return best


def test_least_ways_against_a_search():
    r = random.Random(1)
    cases = ["", "u", "a", "s", "x", "o", "U", "su", "us", "ss", "uaua", "auau", "xx"] + ["".join(r.choices("suauaUASoOx", k=r.randint(2, 6))) for _ in range(150)]
    for codes in cases:
        assert repair.solve(codes) == least_way(codes, len(codes) + 4), codes


def repaired_rows(rows: list[tuple]) -> list[tuple]:
    names = {"s": "system", "u": "user", "a": "assistant"}
    own: dict[object, list] = {}
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = own.setdefault(c, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
        mine += [((t is not None, t or 0), digest, role, text)] * (kind != 0) * (1 + (kind == 3))
    out = []
    for c, mine in own.items():
        mine.sort()
        seen, codes, faults = set(), "", [0, 0, 0]
        for _, _, role, text in mine:
            word = re.findall("[^\x20\x09-\x0d]", text)
            fault = 0 if not word else 1 if (role, text) in seen else 2 if word[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in (0, 1) else letter.upper() if fault == 2 else letter
            if fault is not None:
                faults[fault] += 1
        turns = [x[0][1] for x in mine if x[0][0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [x[2][:1] for x in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        cost, audit = repair.solve(codes)
        lines, i, at = [], 0, ""
        for letter in audit:
            role = "assistant" if at == "u" else "user"
            if letter == "I":
                lines.append(f"{role}:")
            else:
                if letter != "D":
                    lines.append(f"{mine[i][2] if letter == 'K' else role}:{mine[i][3]}")
                i += 1
            if letter != "D":
                at = lines[-1][:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines)) and names
        out.append((c, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair_against_brute_force(spark):
    rows = conversations(9) + [(None, 0, "user", "no id."), (None, 1, "assistant", "no id."), (5, 3, "user", "again"), (5, 3, "user", "again")]
    got = repair.repair(repair.damage(frame(spark, rows).repartition(3)))
    assert sorted(map(tuple, got.select(REPAIR).collect()), key=str) == sorted(repaired_rows(rows), key=str)
    assert got.where("audit = ''").count() > 0 and {x for r in got.collect() for x in r.audit} == set("DIKR")
    assert repair.repair(repair.damage(frame(spark, []))).count() == 0


def test_long_conversations_stream(spark):
    """More turns than a batch, of 500 rows in tests, and texts that are never gathered."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in (1, 2) for t in range(1300)] + [(3, 0, "user", "x" * 3_000_000 + ".")]
    got = repair.repair(repair.damage(frame(spark, rows)))
    assert sorted(map(tuple, got.select(REPAIR).collect())) == sorted(repaired_rows(rows))
