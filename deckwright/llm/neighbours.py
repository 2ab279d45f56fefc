"""Approximate nearest neighbours by largest inner product, with an adaptive scan over dimensions.

Vectors get one more component that makes all norms equal, so the largest inner product is the least
distance, and are turned by a random rotation.  After it, the distance over the first d of D dimensions is an
estimate of the whole one with a known spread, and a candidate is abandoned as soon as a test says that its
whole distance exceeds the worst of the neighbours found so far.  Vectors lie in inverted lists (nearest
centroid), a list in blocks of columns: one block holds some dimensions of all its vectors side by side.

* Equal vectors are one candidate with the ``k + 1`` least ids, which are all that a result can need.
* Centroids, and how many lists a query probes, are fitted on a bounded sample (``SAMPLE_ROWS`` distinct
  vectors): the fewest lists that reach ``TARGET_RECALL`` on it.  Neighbours in all rows are nearer than those
  within a sample, so the recall over all rows is not less.  Every row is indexed.
* The sample's vectors are candidates as well; each query starts with the bound that they give.
* A list is cut into blocks of vectors and its queries into blocks of queries, so no task holds a whole list.

Defined cases: rows without an id and vectors that are null, empty, zero, of another length than the commonest one in the searched table, or that hold
null or non-finite components take no part; of rows with one id and different vectors each is a candidate, and
each is asked for, the best score counting; repeated rows are one; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS, LIST_ROWS, TARGET_RECALL = 12_000, 512, 0.95
#: Vectors and queries of a task, and dimensions of a column block.
BLOCK_VECTORS, BLOCK_QUERIES, BLOCK_DIMENSIONS = 8_192, 1_024, 16
#: How many standard errors a partial distance must be off before its candidate goes.
EPSILON = 2.1


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    norm: float  # the largest
    centroids: np.ndarray
    probes: int
    sample: np.ndarray  # rotated
    plain: np.ndarray  # the sample as it is
    ids: list[np.ndarray]

    def rotate(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """With the component that makes norms equal (0 for queries)."""
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(1), 0))
        return np.concatenate([vectors, rest[:, None]], 1) @ self.rotation

    def seeds(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sample are nearest, and the k-th least squared distance (infinite if there are fewer)."""
        away = distances(queries, self.sample)
        if len(self.sample) <= k:
            return np.tile(np.arange(len(self.sample)), (len(queries), 1)), np.full(len(queries), np.inf)
        nearest_ = np.argpartition(away, k - 1, 1)[:, :k]
        return nearest_, np.take_along_axis(away, nearest_, 1).max(1) * (1 + 1e-9)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(vectors, centroids).argmin(1)


def build(sample: np.ndarray, ids: list[np.ndarray], norm: float, rows: int, k: int, seed: int = 11) -> Index:
    """From sampled vectors and their ids, the largest norm and the number of rows."""
    random = np.random.default_rng(seed)
    d = sample.shape[1] + 1
    rotation, _ = np.linalg.qr(random.normal(size=(d, d)))
    plain = Index(rotation, norm, np.zeros((1, d)), 1, np.zeros((0, d)), sample[:0], [])
    turned = plain.rotate(sample)
    # lists grow with the rows up to LIST_ROWS ** 2 of them, and with their square root beyond, so that choosing
    # lists and scanning them take alike; a sample bounds them, as each needs a few of its vectors
    lists = int(min(max(1, rows // LIST_ROWS), math.isqrt(rows), max(1, len(sample) // 4)))
    centroids = turned[random.choice(len(turned), lists, replace=False)]
    for _ in range(8):
        own = nearest(turned, centroids)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, turned)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    own = nearest(turned, centroids)
    asked = random.choice(len(sample), min(256, len(sample)), replace=False)
    queries = plain.rotate(sample[asked], query=True)
    best = np.argsort(-(sample[asked] @ sample.T), 1, kind="stable")[:, 1 : k + 1]
    rank = np.argsort(np.argsort(distances(queries, centroids), 1), 1)
    needed = rank[np.arange(len(asked))[:, None], own[best]]
    probes = next((p for p in range(1, lists + 1) if (needed < p).mean() >= TARGET_RECALL), lists) if best.size else lists
    kept = random.choice(len(turned), min(4096, len(turned)), replace=False)
    return Index(rotation, norm, centroids, probes, turned[kept], sample[kept], [ids[i] for i in kept])


def scan(query: np.ndarray, columns: list[np.ndarray], squares: list[np.ndarray], limit: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that survive, and their squared distances: all that can be among the k nearest, but for the
    tests' errors.  ``columns`` has blocks of (dimensions, vectors), ``squares`` their squared lengths."""
    d, done = len(query), 0
    alive, total = None, None
    for block, square in zip(columns, squares, strict=True):
        part = query[done : done + len(block)]
        away = square - 2 * (part @ block) if alive is None else square[alive] - 2 * (part @ block[:, alive])
        total = away + part @ part if total is None else total + (away + part @ part)
        done += len(block)
        if done < d:
            keep = total <= limit * (done / d) * (1 + EPSILON / np.sqrt(done)) ** 2
        else:
            if len(total) > k:
                limit = min(limit, np.partition(total, k - 1)[k - 1])
            keep = total <= limit + 1e-9
        kept = np.flatnonzero(keep)
        if len(kept) < len(total):
            alive, total = (kept if alive is None else alive[kept]), total[kept]
            if not len(alive):
                break
    return (np.arange(len(total)) if alive is None else alive), total


def best_ids(scores: np.ndarray, ids: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores over all ids of the candidates, ties to smaller ids."""
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    each = np.repeat(scores, [len(x) for x in ids])
    order = np.lexsort((flat, -each))[:k]
    return flat[order], each[order]


def usable(vectors: DataFrame, key: str, column: str, length: int | None = None) -> DataFrame:
    """(id, vector of doubles) of the rows that take part: of this length, or of any."""
    x = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("vector", lambda c: c != 0)
    )
    return rows if length is None else rows.where(F.size("vector") == length)


def commonest(rows: DataFrame) -> int:
    """The length of most vectors, 0 if there are none."""
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes["n"] if sizes else 0


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k nearest found of each query among all other ids."""
    every = usable(vectors, key, column)
    length = commonest(every)
    rows = every.where(F.size("vector") == length)
    asked = usable(queries, key, column, length).withColumnRenamed("vec_id", "query_id")
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    members = rows.distinct().withColumn("n", first).where(F.col("n") <= k + 1)  # limited before the shuffle, too
    groups = common.cut(members.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.col("ids")[0]))
    total, norm = groups.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], result)
    drawn = groups.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("vector", "ids").toArrow()
    drawn_ids = [np.array(x, np.int64) for x in drawn.column("ids").to_pylist()]
    sample = drawn.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(drawn), -1)
    context = vectors.sparkSession.sparkContext
    index = context.broadcast(build(sample, drawn_ids, float(np.sqrt(norm)), total, k))
    wide = k + 1

    def to_lists(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 4096):
                part = frame.iloc[a : a + 4096]
                turned = index.value.rotate(np.stack(part["vector"].to_numpy()))
                yield part.assign(list=nearest(turned, index.value.centroids).astype(np.int32))

    def to_probes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 1024):
                part = frame.iloc[a : a + 1024]
                turned = index.value.rotate(np.stack(part["vector"].to_numpy()), query=True)
                order = np.argsort(distances(turned, index.value.centroids), 1)[:, : index.value.probes].astype(np.int32)
                chosen, bounds = index.value.seeds(turned, wide)
                seeds = []
                for vector, found in zip(part["vector"], chosen, strict=True):
                    ids, scores = best_ids(index.value.plain[found] @ np.asarray(vector), [index.value.ids[i] for i in found], wide)
                    seeds.append([{"vec_id": int(i), "score": float(s)} for i, s in zip(ids, scores, strict=True)])
                yield part.assign(lists=list(order), bound=bounds, seeds=seeds)

    def near(frame: pd.DataFrame) -> pd.DataFrame:
        data, ask = frame[~frame["asks"]], frame[frame["asks"]]
        if not len(data) or not len(ask):
            return pd.DataFrame({"rep": [], "vec_id": [], "score": []})
        own = np.stack(data["vector"].to_numpy())
        turned = np.ascontiguousarray(index.value.rotate(own).T)
        columns = [turned[i : i + BLOCK_DIMENSIONS] for i in range(0, len(turned), BLOCK_DIMENSIONS)]
        squares = [(block**2).sum(0) for block in columns]
        ids = [np.asarray(x, np.int64) for x in data["ids"]]
        plain = np.stack(ask["vector"].to_numpy())
        reps, found, scores = [], [], []
        for rep, vector, query, limit in zip(ask["rep"], plain, index.value.rotate(plain, query=True), ask["bound"], strict=True):
            alive, _ = scan(query, columns, squares, limit, wide)
            if len(alive):
                best, score = best_ids(own[alive] @ vector, [ids[i] for i in alive], wide)
                reps.append(np.full(len(best), rep))
                found.append(best)
                scores.append(score)
        join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
        return pd.DataFrame({"rep": join(reps, np.int64), "vec_id": join(found, np.int64), "score": join(scores, np.float64)})

    listed = common.cut(groups.mapInPandas(to_lists, "vector array<double>, ids array<long>, rep long, list int"))
    shared = asked.join(groups.select("vector", "rep"), "vector").select("query_id", "rep").distinct()
    distinct = shared.select("rep").distinct().join(groups.select("rep", "vector"), "rep")
    probing = common.cut(distinct.select("rep", "vector").mapInPandas(to_probes, "rep long, vector array<double>, lists array<int>, bound double, seeds array<struct<vec_id:long,score:double>>"))
    seeds = probing.select("rep", F.explode("seeds").alias("s")).select("rep", "s.vec_id", "s.score")
    probing = probing.select("rep", "vector", "bound", F.explode("lists").alias("list"))
    # how many blocks each list needs: one row a list, at most a quarter of SAMPLE_ROWS
    sizes = listed.groupBy("list").count().withColumn("vb", F.ceil(F.col("count") / BLOCK_VECTORS).cast("int")).select("list", "vb")
    sizes = sizes.join(probing.groupBy("list").count().withColumn("qb", F.ceil(F.col("count") / BLOCK_QUERIES).cast("int")).select("list", "qb"), "list")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = listed.join(F.broadcast(sizes), "list").select("list", block("vb").alias("v"), every("qb").alias("q"), F.lit(False).alias("asks"), "rep", "vector", "ids", F.lit(0.0).alias("bound"))
    right = probing.join(F.broadcast(sizes), "list").select("list", every("vb").alias("v"), block("qb").alias("q"), F.lit(True).alias("asks"), "rep", "vector", F.array().cast("array<long>").alias("ids"), "bound")
    found = left.unionByName(right).groupBy("list", "v", "q").applyInPandas(near, "rep long, vec_id long, score double")
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    found = found.unionByName(seeds).groupBy("rep", "vec_id").agg(F.max("score").alias("score"))
    top = found.withColumn("n", ranked("rep")).where(F.col("n") <= wide)
    pairs = shared.join(top.select("rep", "vec_id", "score"), "rep").where(F.col("query_id") != F.col("vec_id"))
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return pairs.withColumn("rank", ranked("query_id")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
