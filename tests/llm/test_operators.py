"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeated
rows, empty tables and extra columns with clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from deckwright.llm import bpe, components, decontaminate, induced_sort, jaccard, licenses, neighbours, quality, queries, sharding, suffix_dedup, token_files, toxicity

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key int, block int, part int"


def fixture(n: int = 60, seed: int = 3) -> list[tuple[int, str | None]]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéñ", k=r.randint(1, 7))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    base = words(200)
    passage = " ".join(words(30))
    out: list[tuple[int, str | None]] = [(900, None), (901, ""), (902, "  \n"), (903, "one"), (904, "One  TWO"), (905, "x" * 300), (906, "x" * 300), (907, "ab " * 400)]
    for i in range(n):
        kind = i % 6
        text = " ".join(words(r.randint(3, 120)))
        if kind == 0:
            own = base.copy()
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            text = " ".join(own)
        elif kind == 1:
            text = " ".join(base).upper() if i % 4 else " ".join(base)
        elif kind == 2:
            text += " " + passage + "\n" + " ".join(words(5))
        out.append((i * 3, text))
    out.append((10_000, " ".join(words(6000))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5, 1, 2, 3) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, fixture()).repartition(5).cache()


def test_sharding(spark, docs, tmp_path):
    eight = {s: 1.0 for s in range(8)}
    rows = sharding.shard(docs.union(docs.limit(7)), eight, eight | {8: 1.0}).collect()
    assert len(rows) == docs.count() + 7
    texts = dict(fixture())
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard(docs.limit(0), eight).count() == 0
    sharding.write(docs, str(tmp_path / "shards"), eight)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert set(back.columns) == {*docs.columns, "shard_number"} and back.count() == docs.count()
    placed = {r.doc_id: r.shard for r in rows}
    assert all(placed[r.doc_id] == r.shard_number and r.text == texts[r.doc_id] for r in back.collect())
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    share = {r.shard: r["count"] for r in sharding.shard(many, {0: 1.0, 1: 3.0}).groupBy("shard").count().collect()}
    assert 0.72 < share[1] / 20_000 < 0.78


def test_bpe_and_token_files_are_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    odd = [(20_000 + i, t) for i, t in enumerate(["a<|endoftext|>b", "<|ENDOFTEXT|>", "İSTANBUL ΣΑΣ", "don't we'll 's", "é é ﬁ ½", "日本 👩‍👩‍👧", "\x1c\x1d a\x85b　c", "123 4５", "q" * 400, "!?" * 200, "ͅ Α", "<|x", "word's it'll. foo''"])]
    own = docs.union(frame(spark, odd))
    texts = dict(fixture() + odd)
    got = {r.doc_id: r for r in bpe.digests(own, path).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()), text
    token_files.write(own, str(tmp_path / "t"), path, 2)
    start = 0
    read = {r.doc_id: r for r in token_files.read(spark, str(tmp_path / "t")).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (read[i].start, read[i].n_tokens, read[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    token_files.write(docs.limit(0), str(tmp_path / "e"), path, 2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_segments_round_trip():
    random_ = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        ids = np.where(random_.random(n) < 0.03, random_.integers(0, 2**32, n), random_.integers(500, 900, n)).astype(np.uint32)
        lengths = np.array([n // 3, 0, n - n // 3])
        data = token_files.write_segment(np.array([5, 6, 7]), lengths, ids)
        back = token_files.read_segment(data)
        assert back[0].tolist() == [5, 6, 7] and back[1].tolist() == lengths.tolist() and (back[2] == ids).all()
        assert (token_files.read_segment(data, 2)[2] == ids[n // 3 :]).all()


def test_blocks_follow_the_format_and_words_are_learnt_once():
    random_ = np.random.default_rng(1)
    values = np.where(random_.random(1000) < 0.05, random_.integers(0, 2**32, 1000), random_.integers(9, 300, 1000)).astype(np.uint32)
    raw, sizes = token_files.pack(values)
    at = 0
    for k, size in enumerate(sizes.tolist()):  # each block by itself, a value at a time
        own = values[k * 128 : (k + 1) * 128].tolist()
        own += [own[-1]] * (128 - len(own))
        least, width, over = struct.unpack_from("<IBB", raw, at)
        bits = int.from_bytes(raw[at + 6 : at + 6 + 16 * width], "little")
        places = raw[at + 6 + 16 * width :][:over]
        high = dict(zip(places, struct.unpack_from(f"<{over}I", raw, at + 6 + 16 * width + over), strict=True))
        assert least == min(own) and [least + high.get(i, bits >> i * width & (1 << width) - 1) for i in range(128)] == own
        at += size
    assert at == len(raw)
    memory, asked = token_files.Encoder(queries.vocabulary()).memory, []
    words = [b"w%d" % i for i in range(300_000)]
    for a in [*range(0, len(words), 50_000)] * 2:
        memory.recall(words[a : a + 50_000], lambda new: asked.extend(new) or [b"1234"] * len(new))
    assert len(asked) == len(words)


def shingles(text: str | None, k: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("rule", [jaccard.Rule(3, Fraction(90, 100)), jaccard.Rule(5, Fraction(8, 10)), jaccard.Rule(1, Fraction(1, 2))])
def test_jaccard_classes(spark, docs, rule, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3_000)  # so that gatherings are cut
    monkeypatch.setattr(jaccard, "BLOCK_POINTS", 5)
    texts = dict(fixture())
    sets = {i: shingles(t, rule.size) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and both * rule.share.denominator >= rule.share.numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs, rule).collect()}
    assert got == {i: (len(sets[i]), top(i)) for i in sets}
    kept = jaccard.one_of_each(docs.union(frame(spark, [(None, "without an id")])), rule)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in sets if top(i) == i} | {None}
    assert jaccard.classes(docs.limit(0), rule).count() == 0


def test_signatures_meet_whenever_sets_link():
    random_ = np.random.default_rng(5)
    for rule in (jaccard.Rule(3, Fraction(9, 10)), jaccard.Rule(5, Fraction(8, 10))):
        for _ in range(300):
            n = int(random_.choice([1, 2, 5, 10, 19, 20, 60, 400]))
            a = np.unique(random_.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[random_.random(len(a)) > random_.random() * 0.2], random_.integers(0, 2**63, int(random_.integers(0, n // 8 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and len(np.setxor1d(a, b)) and both * rule.share.denominator >= rule.share.numerator * (len(a) + len(b) - both):  # equal ones meet before
                x, y = jaccard.signatures([a, b], rule)
                assert len(np.intersect1d(x, y))
                p, q = jaccard.matrix([jaccard.point(x).tobytes() for x in (a, b)])
                assert jaccard.Tree(q[None], np.array([len(b)])).partners(p, len(a), rule).tolist() == [0]


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == got[90] == 90
    assert components.components(links.limit(0)).count() == 0


def test_induced_sorting():
    random_ = np.random.default_rng(1)
    for it in range(60):
        body = random_.integers(1, int(random_.choice([2, 3, 5, 30])) + 1, int(random_.integers(1, 90)))
        body = np.tile(body[: max(1, len(body) // 7)], 7) if it % 3 == 0 else body
        s, depth = np.concatenate([body, [0]]), int(random_.choice([1, 3, 50]))
        for options in ({}, {"memory_symbols": 0, "queue_bytes": 10}):
            got = []
            induced_sort.sort(s, depth, lambda p, c, got=got: got.append((p, c)), **options)
            p, c = (np.concatenate([g[i] for g in got[::-1]]).tolist() for i in (0, 1))
            assert sorted(p) == list(range(len(s)))
            t = s.tolist()
            for i in range(1, len(p)):
                a, b = t[p[i - 1] : p[i - 1] + depth], t[p[i] : p[i] + depth]
                assert a <= b
                assert c[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def test_induced_sorting_visits_what_waits_together(monkeypatch):
    body = np.random.default_rng(4).integers(1, 60, 60_000)
    body[40_000:] = body[:20_000]
    sequence, visits, visit = np.concatenate([body, [0]]), [], induced_sort.Scan.visit
    monkeypatch.setattr(induced_sort.Scan, "visit", lambda scan, positions, *more: (visits.append(len(positions)), visit(scan, positions, *more))[1])
    found = []
    for step, queue in ((induced_sort.STEP, None), (7, 100_000)):
        monkeypatch.setattr(induced_sort, "STEP", step)
        visits.clear()
        got = []
        induced_sort.sort(sequence, 50, lambda p, c, got=got: got.append((p, c)), queue_bytes=queue)
        found.append([np.concatenate([g[i] for g in got[::-1]]) for i in (0, 1)])
        if step > 7:
            assert len(visits) < 60 * 8  # a few a symbol and scan, not one for each push
    raw = body.astype(np.uint8).tobytes()
    keys = [raw[p : p + 50] for p in found[0][0].tolist()]
    assert keys == sorted(keys) and len(set(found[0][0].tolist())) == len(sequence)
    # suffixes equal in 50 symbols may come in any order, the values are the same
    assert np.array_equal(found[0][1], found[1][1])
    assert [raw[p : p + 50] for p in found[1][0].tolist()] == keys


def brute_dedup(texts: dict, length: int = 50) -> dict:
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        strings = [data[k : k + length] for k in range(len(data) - length + 1)]
        lost = bytearray(len(data))
        for k, s in enumerate(strings):
            if s in seen:
                lost[k : k + length] = b"\1" * length
        seen.update(strings)
        kept = bytes(c for c, x in zip(data, lost, strict=True) if not x)
        out[i] = (len(data), sum(lost), len(re.findall(b"\1+", bytes(lost))), hashlib.sha256(kept).hexdigest())
    return out


def test_a_word_counts_once_in_each_passage():
    chance = np.random.default_rng(3)
    at = np.array([0, 0, 5, 17, 60, 260])
    numbers = chance.integers(0, 9, 260)
    numbers[17:30] = [0, *range(1, 10), 0, 11, 12]  # word 0 again, 10 words on
    values = chance.normal(size=20)
    values[[0, 11, 12]] = 5
    best, start = toxicity.best_windows(values[numbers], numbers, at)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        width = min(toxicity.WINDOW, b - a)
        sums = {i: values[np.unique(numbers[i : i + width])].sum() / max(width, 1) for i in range(a, b - width + 1)}
        assert np.isclose(best[k], max(sums.values())) and np.isclose(sums[start[k]], best[k])


def test_equal_fragments_go_to_their_shard_once_a_part():
    passage = bytes(np.random.default_rng(4).integers(97, 123, 300, np.uint8)).decode()
    texts = [f"{k:060d} {passage} {k * 7919:060d}" for k in range(40)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    docs, starts, counts, codes = suffix_dedup.fragments(data, offsets, 50, 20)
    some = suffix_dedup.shared_within(codes, docs)[0]
    packed = suffix_dedup.packed(rows=docs[some], starts=starts[some].astype(np.int32), counts=counts[some].astype(np.uint8), codes=np.zeros(some.sum(), np.int32))
    entries = pa.Table.from_pylist([packed])
    rows = suffix_dedup.cut_fragments(1, 50)(entries, pa.table({"row": np.arange(40), "doc_id": np.arange(40), "text": texts})).to_pylist()
    (sent,) = (r for r in rows if r["shard"] == 0)
    sizes = np.frombuffer(sent["counts"], np.uint8).astype(int) + 49
    ends = np.cumsum(sizes)
    held = [sent["bytes"][e - n : e].decode() for e, n in zip(ends, sizes)]
    inside = [f for f in held if f in passage]
    assert inside and len(inside) == len(set(inside))
    lost = {}
    for table in (suffix_dedup.sort_shard(1, 50)(pa.Table.from_pylist([r])) for r in rows):
        for part in table.to_pylist():
            for d, a, b in zip(*(np.frombuffer(part[c], "<i8").tolist() for c in ("ids", "starts", "ends"))):
                lost.setdefault(d, set()).update(range(a, b))
    want = {}
    for k, text in enumerate(texts):
        found = [i for i in range(len(text) - 49) if any(text[i : i + 50] in t for t in texts[:k])]
        want[k] = {x for i in found for x in range(i, i + 50)}
    assert {k: lost.get(k, set()) for k in range(40)} == want


def test_suffix_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 9_000)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 9_000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(docs).collect()}
    assert got == brute_dedup(dict(fixture()))
    kept = suffix_dedup.remove(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in kept.where("text IS NOT NULL").collect())
    again = suffix_dedup.report(kept.where("doc_id < 900"))
    assert again.count()
    assert suffix_dedup.report(docs.limit(0)).count() == 0
    same = frame(spark, [(1, "a" * 60 + "b" * 60), (1, "a" * 60 + "b" * 60), (1, "c" * 70), (None, "c" * 70)])
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.report(same).collect())
    assert got == [(-1, 0), (1, 0), (1, 0), (1, 70)]


def test_rows_with_one_id_lose_only_their_own_bytes(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = word(90)
    rows = [(1, word(30) + shared), (2, shared + word(40)), (2, word(105)), (2, None), (3, word(105)), (2, shared + word(41))]
    clash = spark.createDataFrame([(i, t, t, i, True) for i, t in rows], "doc_id long, text string, c0 string, _key long, _copy boolean")
    got = {(x.doc_id, x.n_bytes): (x.n_removed, x.n_spans) for x in suffix_dedup.report(clash).collect()}
    assert got == {(1, 120): (0, 0), (2, 130): (90, 1), (2, 131): (90, 1), (2, 105): (0, 0), (2, 0): (0, 0), (3, 105): (0, 0)}
    kept = suffix_dedup.remove(clash)
    assert kept.columns == clash.columns and sorted(len(x.text or "") for x in kept.collect()) == [0, 40, 41, 105, 105, 120]


def test_a_shard_larger_than_its_queues_spills_with_production_parameters(monkeypatch):
    spills = []
    closing = induced_sort.Queue.close
    monkeypatch.setattr(induced_sort.Queue, "close", lambda q: (spills.append(q.spilled), closing(q)))
    data = np.random.default_rng(6).integers(97, 105, 1_200_000).astype(np.uint16)
    data[600_000:900_000] = data[:300_000]
    sequence = np.concatenate([data, np.zeros(1, np.uint16)])
    order = []
    induced_sort.sort(sequence, 50, lambda p, c: order.append(p))
    order = np.concatenate(order[::-1])
    raw = data.astype(np.uint8).tobytes()
    assert sum(spills) > 0 and len(np.unique(order)) == len(sequence)
    keys = [raw[p : p + 50] for p in order[:: len(order) // 20_000].tolist()]
    assert keys == sorted(keys)


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_decontamination(spark, docs):
    texts = dict(fixture())
    some = [t for t in texts.values() if t and len(t.split()) > 60]
    bench = [("b1", " ".join(some[0].split()[5:40])), ("b2", "one two"), ("b3", some[1].upper().replace(" ", ", ")), ("b4", ""), ("b5", None), ("b6", "x x x"), ("b2", " ".join(some[2].split()[3:16])), ("b7", "ab")]
    windows: dict[tuple, set] = {}
    for name, text in bench:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        for k in range(max(len(w) - 10, 0) + 1) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(name)
    items = spark.createDataFrame([(a, b, 1) for a, b in bench], "item_id string, text string, n_hit int")
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, names = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    names |= windows[x]
                    hit[k : k + n] = [1] * n
        want = (len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit))
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == want
    clean = decontaminate.remove(docs, items)
    assert clean.columns == docs.columns and decontaminate.report(clean, items).where("contaminated").count() == 0
    assert decontaminate.report(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_neighbours(spark):
    random_ = np.random.default_rng(2)
    vectors = [list(map(float, v)) for v in random_.normal(size=(3000, 24))]
    vectors[10:60] = [vectors[10]] * 50
    rows = [(i, v) for i, v in enumerate(vectors)] + [(9000, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [1.0]), (9080, []), (9100, [None, *vectors[0][1:]])]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "vec_id long, embedding array<double>, score double")
    got = neighbours.search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    x = np.array(vectors)
    found = wanted = 0
    for q, mine in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], s[mine["vec_id"]])
        assert list(zip(-mine["score"], mine["vec_id"], strict=True)) == sorted(zip(-mine["score"], mine["vec_id"], strict=True))
        found, wanted = found + len(set(best) & set(mine["vec_id"])), wanted + 20
    assert got["query_id"].nunique() == 150 and found / wanted >= 0.9
    # ids that are null take no part, and the table decides which length counts, not the queries
    odd = [(None, vectors[7]), (None, vectors[8])] + [(10_000 + 20 * i, [1.0, 2.0]) for i in range(200)]
    wide = df.union(spark.createDataFrame([(*r, 0.5) for r in odd], df.schema))
    again = neighbours.search(wide, wide.where("vec_id % 20 = 0 AND (vec_id < 60 OR vec_id >= 10000)"), 20)
    assert {r.query_id for r in again.select("query_id").distinct().collect()} == {0, 20, 40} and again.where("vec_id IS NULL").count() == 0
    few = df.where("vec_id < 5")
    assert neighbours.search(few, few.where("vec_id = 0"), 20).count() == 4
    assert neighbours.search(df.limit(0), df.limit(0), 20).count() == 0


def labelled(seed: int, n: int = 400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghil", k=r.randint(2, 8))) for _ in range(400)]
    bad = ["wretched", "scoundrel", "blockhead", "numbskull"]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(20, 150))]
        toxic, junk = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(4):
                w = r.choice(bad)
                k = r.randrange(1, len(w))
                words.insert(r.randrange(len(words)), w if r.random() < 0.7 else w[:k] + w[k - 1 :])
        text = " | ".join(words).upper() + "!!" if junk else " ".join(words)
        rows.append((i, text, int(not junk), int(toxic)))
    return rows


@pytest.mark.parametrize("module,label,column", [(toxicity, "toxic", 3), (quality, "quality", 2)])
def test_classifiers(spark, module, label, column):
    rows = labelled(9)
    docs = frame(spark, [(i, t) for i, t, _, _ in rows] + [(5000, None), (5001, ""), (5002, "é" * 3000)])
    labels = spark.createDataFrame([(r[0], r[column]) for r in rows if r[0] % 5] + [(None, 1), (4, None)], f"doc_id long, {label} int")
    scores = {r.doc_id: r.score for r in module.score(docs, module.fit(docs, labels)).collect()}
    assert len(scores) == len(rows) + 3 and all(0 <= s <= 1 for s in scores.values())
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum((scores[r[0]] >= 0.5) == bool(r[column]) for r in held) / len(held) >= 0.9
    nobody = module.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in module.score(docs, nobody).collect()} == {0.5}
    assert module.score(docs.limit(0), nobody).count() == 0


def test_a_misspelling_never_seen_is_caught():
    rows = labelled(9)
    model = toxicity.train(pa.array([r[1] for r in rows], pa.string()), np.array([r[3] for r in rows]))
    clean = " ".join(rows[1][1].split()[:60])
    both = model.scores(pa.array([clean + " scoundrell blockheadd numbskulll wretchedd", clean], pa.string()))
    assert both[0] >= 0.5 > both[1]


def test_licenses(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choices("abcdefgo", k=r.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(80) + "\n" + prose(40)) for i in range(60)]
    rows += [(100, prose(20) + "\nReleased under the MIT License.\n" + prose(9)), (101, "Licensed under the Apache License, Version 2.0."), (102, "This work is licensed under the GNU General Public License, version 3."), (103, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.")]
    rows += [(104, None), (105, ""), (106, "My driving license is of no use to the general public."), (101, "Licensed under the Apache License, Version 2.0."), (None, "Released under the MIT License."), (None, prose(9))]
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in licenses.scan(docs, licenses.fit(docs)).collect()}
    assert {i: x.families for i, x in got.items() if x.families} == {100: "mit", 101: "apache-2.0", 102: "gpl", 103: "cc-by-nc,mit", None: "mit"}
    assert got[101].n_paragraphs == 2 and got[104].n_paragraphs == 0 and got[106].family is None
    assert licenses.scan(docs.limit(0), licenses.fit(docs)).count() == 0
