"""The queries themselves, with production parameters, on the smallest tables."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from deckwright.llm import common, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in common.table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(db.sql(queries.oracle_sql()[name]).select(*columns).fetchall())


@pytest.mark.parametrize("name,n,held,label", [("op3_toxicity", 5, 0, "toxic"), ("op10_quality", 3, 1, "quality")])
def test_classifiers_hold_out_their_fold(spark, texts, name, n, held, label):
    rows = queries.queries()[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    known = {r.doc_id: r[label] for r in common.table(spark, SF, "labels").collect()}
    judged = [r.predicted == known[r.doc_id] for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert not judged or np.mean(judged) >= 0.7  # of a few dozen rows


def test_neighbours_against_every_pair(spark):
    vectors = {r[0]: np.array(r[1], float) for r in common.table(spark, SF, "embeddings").select("vec_id", "embedding").collect() if r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(np.array(r[1], float))}
    ids, x = np.array(sorted(vectors)), np.stack([vectors[i] for i in sorted(vectors)])
    got = queries.op1_adaptive_scan(spark, SF).toPandas()
    assert set(got["query_id"]) == {i for i in vectors if i % 20 == 0}
    found = 0
    for q, mine in got.groupby("query_id"):
        score = x @ vectors[q]
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        mine = mine.sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine["score"], [vectors[i] @ vectors[q] for i in mine["vec_id"]])
        found += len(best & set(mine["vec_id"]))
    assert found >= 0.9 * len(got)


def test_token_queries_agree(spark, texts):
    files = {r.doc_id: r for r in queries.op4_token_files(spark, SF).collect()}
    words = {r.doc_id: r for r in queries.op6_bpe(spark, SF).collect()}
    assert set(files) == set(words) == set(texts)
    start = 0
    for i in sorted(texts):
        assert files[i].n_tokens == words[i].n_tokens + 1 and files[i].start == start
        start += files[i].n_tokens


def test_shards_follow_the_law_of_keys(spark, texts):
    rows = queries.op8_rendezvous_shards(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and {r.law for r in rows} == {"key"}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data)) and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))


def test_licences_cover_every_document(spark, texts):
    rows = queries.op9_license_scan(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all((r.n_paragraphs > 0) == bool(r.families) for r in rows)
    named = [r for r in rows if "MIT License" in texts[r.doc_id]]
    assert all("mit" in r.families for r in named)


def test_nulls_in_ids_and_texts(spark, tmp_path):
    """Every query on documents, with null ids and texts, repeated rows and no rows at all."""
    docs = common.table(spark, SF, "documents").limit(60)
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2))
    for name, table in (("some", docs.unionByName(odd)), ("none", docs.limit(0))):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        for other in ("labels", "benchmark"):
            common.table(spark, SF, other).write.parquet(str(folder / f"{other}.parquet"))
        n = table.count()
        for query in (queries.op4_token_files, queries.op5_fm_index, queries.op6_bpe, queries.op7_suffix_dedup, queries.op8_rendezvous_shards):
            assert query(spark, str(folder)).count() == n, query.__name__
        assert queries.op2_ngram_jaccard(spark, str(folder)).count() == table.select("doc_id").where("doc_id IS NOT NULL").distinct().count()
