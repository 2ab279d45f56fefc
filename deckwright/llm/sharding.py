"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

A record goes to the shard whose score ``-ln(u) / weight`` is least, ``u`` being a uniform number hashed from
the record's key and the shard's number.  Only the key and the shards decide, so adding a shard moves just
the records that the new shard wins, and its share follows its weight.

Defined cases: a null key is a key of its own; a null text has no bytes; repeated rows go to one shard and
take a slot each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one task numbers; the slots of a shard are dealt in blocks of about this size.
BLOCK_ROWS = 50_000


def rendezvous(key: F.Column, weights: Mapping[int, float]) -> F.Column:
    """The shard of a key."""

    def score(shard: int, weight: float) -> F.Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**53))) / F.lit(float(weight))

    scored = [F.struct(score(s, w).alias("score"), F.lit(s).cast("int").alias("shard")) for s, w in sorted(weights.items())]
    return F.array_min(F.array(*scored))["shard"]


def shard(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None, key: str = "doc_id") -> DataFrame:
    """Key, size, text_crc32, shard, slot (gapless from 0 within a shard) and, if ``grown`` weights are given,
    the shard under those.

    Slots are counted without one task holding a shard: rows are dealt to blocks by hash, numbered within a
    block, and each block starts where the blocks before it in its shard end.
    """
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))
    # at most shards * blocks rows, in blocks of one shard; a sum over them is a small job
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("number", number).join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("number") - 1).cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, weights: Mapping[int, float], key: str = "doc_id") -> None:
    """The whole rows, with all their columns, as Parquet in a folder for each shard (``shard_number=...``).  Rows are
    dealt to tasks by shard and block, so that no task writes more of a shard than about ``BLOCK_ROWS`` rows."""
    taken = {c.lower() for c in docs.columns}
    name = next(n for i in range(len(taken) + 1) if (n := "shard_number" + "_" * i) not in taken)
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    placed = docs.withColumn(name, rendezvous(F.col(key), weights))
    placed.repartition(len(weights) * blocks, name, F.pmod(F.xxhash64(key), F.lit(blocks))).write.partitionBy(name).parquet(path)
