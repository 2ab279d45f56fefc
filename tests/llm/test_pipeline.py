"""The pipeline on a small corpus, each stage held against a brute-force version on its own input."""

from __future__ import annotations

import hashlib
import struct
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from deckwright.llm import common, queries, suffix_dedup

from .test_operators import DOCS, brute_dedup, fixture, labelled, shingles


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    bad = labelled(9)
    rows = [(i, t) for i, t in fixture()] + [(30_000 + i, t) for i, t, _, _ in bad]
    columns = [c.split()[0] for c in DOCS.split(", ")][:5]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ", ".join(DOCS.split(", ")[:5]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    known = [(30_000 + i, q, x) for i, _, q, x in bad] + [(i, 1, 0) for i, _ in fixture()]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join(dict(fixture())[9].split()[:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = common.table(spark, str(tmp_path), "documents")
    seen = [{r.doc_id: r.text for r in now.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == columns, name
            seen.append({r.doc_id: r.text for r in now.collect()})
    toxic = {30_000 + r[0] for r in bad if r[3]}
    clean = set(seen[0]) - toxic
    assert len(set(seen[1]) & toxic) <= 5 and len(clean - set(seen[1])) <= 0.03 * len(clean)
    root = {i: i for i in seen[1]}

    def top(i):
        return i if root[i] == i else top(root[i])

    sets = {i: shingles(t, 5) for i, t in seen[1].items()}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 10 * (both := len(sets[a] & sets[b])) >= 8 * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert set(seen[2]) == {i for i in sets if top(i) == i}
    want = brute_dedup(seen[2])
    assert set(seen[3]) == {i for i, (n, lost, _, _) in want.items() if not lost or n > lost and (i not in seen[3] or seen[3][i].strip())}
    for i, (_, lost, _, digest) in want.items():
        if i in seen[3] and lost:
            data = b"".join([seen[3][i].encode()])
            assert hashlib.sha256(data).hexdigest() == digest or not seen[2][i].isascii()
    assert item.split()[4:14] and " ".join(item.split()[4:14]) not in " ".join(t or "" for t in seen[4].values())
    library = Tokenizer.from_file(queries.vocabulary())
    for r in now.collect():
        ids = library.encode(seen[4][r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids)) == (len(ids), ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.ids_sha256) for r in again.collect()} == {(r.doc_id, r.ids_sha256) for r in now.collect()}


def test_stages_ask_for_small_batches(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "s", 12) for i in range(2500)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    spark.conf.set(corpus_pipeline.BATCH_SETTING, 10_000)
    try:
        corpus_pipeline.encode(spark, docs, "")
        assert docs.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").agg({"n": "max"}).first()[0] <= corpus_pipeline.BATCH_ROWS
        spark.conf.set(corpus_pipeline.BATCH_SETTING, 7)
        corpus_pipeline.encode(spark, docs, "")
        assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "7"
    finally:
        spark.conf.unset(corpus_pipeline.BATCH_SETTING)


def test_a_shard_is_sorted_in_little_memory():
    random_ = np.random.default_rng(3)
    n, size = 8_000, 120
    bodies = [bytes(random_.integers(97, 123, size).tolist()) for _ in range(n // 2)] * 2
    column = lambda x: [np.asarray(x).tobytes()]
    schema = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "starts", "counts", "bytes"))])
    ids = np.arange(n, dtype=np.int64)
    counts = np.full(n, size - 49, np.uint8)
    table = pa.table({"shard": [0], "rows": column(ids), "ids": column(ids), "starts": column(np.zeros(n, np.int32)), "counts": column(counts), "bytes": [b"".join(bodies)]}, schema=schema)
    tracemalloc.start()
    out = suffix_dedup.sort_shard(1, 50)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(np.frombuffer(b"".join(out.column("ids").to_pylist()), "<i8").tolist()) == list(range(n // 2, n))
    assert peak < 43 * n * size
