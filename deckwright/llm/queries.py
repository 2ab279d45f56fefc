"""The operators over the whole shared tables, each as one digest query."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, jaccard, licenses, neighbours, oracle, quality, repair, sharding, suffix_dedup, threshold, token_files, toxicity, trie
from .common import table

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write."""
    return f"{common.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), jaccard.Rule(3, Fraction(90, 100)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.remainder("doc_id", 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary(), END_ID)
    return token_files.read(spark, path)


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    eight = {s: 1.0 for s in range(8)}
    return sharding.shard(table(spark, sf_dir, "documents"), eight, eight | {8: 1.0}).withColumn("law", F.lit("key"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = licenses.scanned(docs)
    return licenses.scan(docs, licenses.fit(docs, seen), seen)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = common.remainder("doc_id", 3) == 1
    scored = quality.score(docs, quality.fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.with_shared_heads(trie.turns(table(spark, sf_dir, "conversations")), 20, 4))


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return threshold.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_adaptive_scan, op2_ngram_jaccard, op3_toxicity, op4_token_files, op5_fm_index, op6_bpe, op7_suffix_dedup, op8_rendezvous_shards, op9_license_scan, op10_quality, op11_prefix_trie, op12_threshold_search, op13_structure_repair)}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
