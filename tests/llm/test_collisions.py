"""Words that a polynomial modulo 2**64 takes for one another, and labelled ids that repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from deckwright.llm import atoms, bpe, common, decontaminate, jaccard, queries, textscan, token_files

#: Thue-Morse words and their complements.
PAIRS = [("".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))) for n in (1024, 2048, 4096)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{text} end of it") for i, text in enumerate(t for pair in PAIRS for t in pair)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_codes_tell_them_apart():
    raw = np.frombuffer("".join(a + b for a, b in PAIRS).encode(), np.uint8)
    ends = np.cumsum([len(t) for pair in PAIRS for t in pair])
    starts = np.concatenate([[0], ends[:-1]])
    assert len(set(textscan.word_codes(raw, starts, ends).tolist())) == 6
    assert len(set(textscan.span_hash(textscan.prefix_hash(raw), starts, ends).tolist())) < 6  # why words have codes
    long = np.tile(np.frombuffer(b"xyz ", np.uint8), (1 << 22) + 5)  # terms are reduced here, and not below
    assert textscan.word_codes(long, np.array([0, 1 << 24]), np.array([3, (1 << 24) + 3])).tolist() == textscan.word_codes(long[:4], np.array([0, 0]), np.array([3, 3])).tolist()


def test_ids_are_those_of_the_library(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    got = {r.doc_id: r for r in bpe.digests(docs, queries.vocabulary()).collect()}
    for i, ids in want.items():
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    token_files.write(docs, str(tmp_path / "f"), queries.vocabulary(), 2)
    import zlib

    files = {r.doc_id: r.ids_crc32 for r in token_files.read(spark, str(tmp_path / "f")).collect()}
    assert files == {i: zlib.crc32(np.array([*ids, 2], "<u4").tobytes()) for i, ids in want.items()}


def test_no_false_links_or_hits(spark, docs):
    from fractions import Fraction

    bare = docs.select("doc_id", F.split("text", " ")[0].alias("text"))
    assert all(r.doc_id == r.component_id for r in jaccard.classes(bare, jaccard.Rule(3, Fraction(90, 100))).collect())
    items = spark.createDataFrame([("q", PAIRS[0][0])], "item_id string, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.report(bare, items).collect()} == {0: 1} | dict.fromkeys(range(1, 6), 0)


def test_memory_compares_bytes():
    memory = atoms.Memory(400)
    learned: list[str] = []
    learn = lambda words: [learned.append(w) or w.encode() for w in words]
    assert memory.recall([b"x", b"y"], learn) == [b"x", b"y"] and memory.recall([b"y", b"z"], learn) == [b"y", b"z"] and learned == ["x", "y", "z"]


def test_training_rows_and_bytes_are_bounded(spark):
    rows = [(1, f"row {i}") for i in range(10_000)] + [(i, "t" * i) for i in range(2, 40)] + [(50, None), (51, "x" * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    chosen = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, label int")
    got = common.training_texts(docs, chosen, 400).to_pylist()
    assert [(r["doc_id"], r["label"]) for r in got] == [(i, i % 2) for i in [*range(1, 40), 50]] and got[0]["text"] == "row 0" and got[-1]["text"] == ""
    few = common.training_texts(docs, chosen, 400, 200).to_pylist()
    assert 0 < sum(len(r["text"]) for r in few) <= 200 and len(few) < len(got)
