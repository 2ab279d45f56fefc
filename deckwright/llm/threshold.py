"""Exact top-k search by integer inner product: Fagin's threshold algorithm over sorted per-dimension lists.

A component counts as floor(256 * x).  Distinct vectors are dealt out over shards, and a task joins one shard with one
block of queries: for each dimension the shard's vectors are a list in order of that component.  A query walks every
list from the end that its own component prefers, a stretch of all lists at a time; what it meets is scored in full,
and it stops as soon as the bound, the inner product with the values at which the lists stand, is below its k-th best
score, as no vector that it hasn't met can then be better or tie.  A list that a query gives no weight isn't walked.

* The k-th best score of a bounded sample of vectors (``SAMPLE_ROWS``, broadcast) is a floor that each query brings
  along, so whole shards are passed over whose best values can't reach it.  The floor only ends walks sooner: results
  are exact with any sample.
* Equal vectors are one candidate with the ``k + 1`` least ids, which are all that a result can need; equal queries are
  asked once.

Defined cases: rows without an id and vectors that are null or hold null or non-finite components take no part; zero and
empty vectors do, with scores of 0; vectors meet those of their own length; rows that share an id are one candidate (the
best score counting) and never answer a query of that id; repeated rows are one; an empty table gives an empty result;
other columns are ignored.  Products that 64 bits can't hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE, SAMPLE_ROWS = 256, 4_096
#: Vectors and queries of a task; entries of each list that the first stretch has, and how stretches grow.
SHARD_VECTORS, BLOCK_QUERIES, FIRST_STRETCH, GROWTH = 8_192, 1_024, 16, 4
RESULT = "query_id long, rank int, vec_id long, score long"


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (held as doubles where these are exact)."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum())
    if most < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most >= 2**62:
        raise ValueError("an inner product might not fit 64 bits")
    return rows.astype(np.int64) @ query.astype(np.int64)


class Lists:
    """A shard's vectors (n, d), and for each dimension their numbers in ascending order of that component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = np.argsort(rows, 0, kind="stable").T  # (d, n)
        self.values = np.take_along_axis(rows.T, self.order, 1)

    def best(self, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """All vectors whose score may be among the k best and is at least ``floor``, with their scores, by the
        threshold algorithm."""
        n = len(self.rows)
        walked = np.flatnonzero(query)
        up = query[walked] < 0  # small components first
        weight = query[walked]
        seen = np.zeros(n, bool)
        found: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        depth, kth = 0, floor
        while depth < n and len(walked):
            # the best that a vector which no list has shown yet can score
            bound = products(np.where(up, self.values[walked, depth], self.values[walked, n - 1 - depth])[None, :], weight)[0]
            if bound < kth:
                break
            deeper = min(n, FIRST_STRETCH if depth == 0 else depth * GROWTH)
            met = np.zeros(n, bool)
            met[self.order[walked[up], depth:deeper]] = True
            met[self.order[walked[~up], n - deeper : n - depth]] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            depth = deeper
            if len(new):
                found.append(new)
                scores.append(products(self.rows[new], query))
                every = np.concatenate(scores)
                if len(every) >= k:
                    kth = max(kth, np.partition(every, len(every) - k)[len(every) - k])
                if len(every) == n:
                    break
        if not len(walked) and 0 >= floor:  # a query without weights: all score 0
            found, scores = [np.arange(n)], [np.zeros(n, np.int64)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        rows, every = np.concatenate(found), np.concatenate(scores)
        kept = every >= kth
        return rows[kept], every[kept]


def first_ids(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores over all ids of the candidates, ties to smaller ids."""
    flat = np.concatenate([np.empty(0, np.int64), *ids])
    each = np.repeat(scores, [len(x) for x in ids])
    order = np.lexsort((flat, -each))[:k]
    return flat[order], each[order]


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, vector of integers) of the rows that take part."""
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE).cast("long")).alias("vector"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k best of each query among all other ids."""
    wide = k + 1
    rows, asked = usable(vectors, key, column), usable(queries, key, column).withColumnRenamed("vec_id", "query_id").distinct()
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = rows.distinct().withColumn("n", first).where(F.col("n") <= wide)  # limited before the shuffle, too
    groups = common.cut(members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    spark = vectors.sparkSession
    sizes = groups.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))  # one row a length of vectors
    drawn = groups.orderBy(F.xxhash64("rep", "vector"), "rep").limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    by_length: dict[int, list[np.ndarray]] = {}
    for x in drawn:
        by_length.setdefault(len(x), []).append(np.asarray(x, np.int64))
    sample = spark.sparkContext.broadcast({n: np.stack(x) for n, x in by_length.items()})

    def floors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.full(len(frame), -np.inf)
            for i, x in enumerate(frame["vector"]):
                query = np.asarray(x, np.int64)
                known = sample.value.get(len(query))
                if known is not None and len(known) >= wide:
                    out[i] = np.partition(products(known, query), len(known) - wide)[len(known) - wide]
            yield frame.assign(floor=out)

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        data, ask = frame[~frame["asks"]], frame[frame["asks"]]
        names, found, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(data) and len(ask):
            lists = Lists(np.stack([np.asarray(x, np.int64) for x in data["vector"]]))
            ids = [np.asarray(x, np.int64) for x in data["ids"]]
            for name, vector, floor in zip(ask["asked"], ask["vector"], ask["floor"], strict=True):
                near, score = lists.best(np.asarray(vector, np.int64), wide, floor)
                best, score = first_ids(score, [ids[i] for i in near], wide)
                names.append(np.full(len(best), name))
                found.append(best)
                scores.append(score)
        return pd.DataFrame({"asked": np.concatenate(names), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    named = asked.select("vector").distinct().mapInPandas(floors, "vector array<long>, floor double")
    named = common.cut(named.withColumn("asked", F.monotonically_increasing_id()))  # numbers hold once they are written
    counts = sizes.withColumn("vb", F.ceil(F.col("n") / SHARD_VECTORS).cast("int"))
    counts = counts.join(named.groupBy(F.size("vector").alias("length")).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb")), "length").select("length", "vb", "qb")
    counts = common.small(common.cut(counts))
    block = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = groups.withColumn("length", F.size("vector")).join(counts, "length").select("length", block("vector", "vb").alias("v"), every("qb").alias("q"), F.lit(False).alias("asks"), F.lit(0).cast("long").alias("asked"), "vector", "ids", F.lit(0.0).alias("floor"))
    right = named.withColumn("length", F.size("vector")).join(counts, "length").select("length", every("vb").alias("v"), block("vector", "qb").alias("q"), F.lit(True).alias("asks"), "asked", "vector", F.array().cast("array<long>").alias("ids"), "floor")
    found = left.unionByName(right).groupBy("length", "v", "q").applyInPandas(meet, "asked long, vec_id long, score long")
    ranked = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    top = found.groupBy("asked", "vec_id").agg(F.max("score").alias("score")).withColumn("n", ranked("asked")).where(F.col("n") <= wide)
    names = asked.join(named.select("vector", "asked"), "vector").select("query_id", "asked")
    pairs = names.join(top.select("asked", "vec_id", "score"), "asked").where(F.col("query_id") != F.col("vec_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", ranked("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
