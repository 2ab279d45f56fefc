"""N-gram Jaccard join with a count-vector R-tree.

A document is the set of its hashed word shingles.  Hashing the shingles into groups makes it a point, the
number of its shingles in each group; two sets share at most the sum of the coordinates' minima, so a tree of
boxes over points finds all partners of a set, and only pairs under that bound are verified on the shingles.

Which documents meet in a tree is decided by groups, too.  Sets with Jaccard similarity t or more differ in at
most (|A| + |B|)(1 - t) / (1 + t) shingles, so with more groups than that at least one group is the same in
both.  A document sends the hash of each of its groups; documents with one in common gather around the least
of them, its center.  No link can be missed:

1. *Stars.*  Points are compared with the center's, and documents under the bound go to one center with their
   text and are verified against it.  A family of near copies mostly ends here, at one move of each text.
2. *The rest.*  A gathering whose documents are not all connected by then is searched by trees over the points,
   in blocks; only documents with a partner under the bound that they aren't connected with yet are verified
   there with their texts.  A large gathering is cut into blocks, and each pair of blocks is a task's work.

Equal sets are found first, by two hashes of the whole set, and joined by their least document only.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; texts with fewer words
than a shingle are one shingle, of all their words; a document id that repeats with different texts stands for
the union of its rows' links (n_shingles: the greatest); rows without an id take no part; an empty table gives an empty result; other
columns of the input are ignored, or kept by :func:`one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan
from .components import components

WORD = textscan.byte_class(r"[^\x20\x09-\x0D]")
#: Points of a leaf and children of a node, least coordinates of a point, shingles that one coordinate counts.
FANOUT, COORDINATES, DENSITY = 16, 32, 4
#: Documents in one block of a gathering of points, and bytes of text in one block of documents to verify.
BLOCK_POINTS, BLOCK_BYTES = 2_048, 6_000_000
#: Keys that are joined apart, as the commonest, and how many a sketch keeps count of to find them.
COMMON_KEYS, TRACKED_KEYS = 256, 10_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``size`` words; documents link at Jaccard similarity ``share`` or more."""

    size: int = 5
    share: Fraction = Fraction(8, 10)

    def links(self, both: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return self.share.denominator * both >= self.share.numerator * (a + b - both)

    def overlap(self, total: np.ndarray) -> np.ndarray:
        """The least intersection of linked sets with so many shingles together."""
        n, d = self.share.numerator, self.share.denominator
        return -(-n * total // (n + d))

    def classes(self) -> np.ndarray:
        """Upper bounds of the classes of sizes."""
        out = [1]
        while out[-1] < 2**40:
            out.append(max(out[-1] + 1, out[-1] * 3 // 2))
        return np.array(out)

    def differences(self, size: int, bound: int) -> int:
        """The most shingles that a set of this size and a linked one of at most ``bound`` do not share."""
        n, d = self.share.numerator, self.share.denominator
        return (size + min(size * d // n, bound)) * (d - n) // (d + n)

    def groups(self, bound: int) -> int:
        """How many groups sets of the class up to ``bound`` fall into: so many that more of them hold shingles
        than can differ, but for about one set in a million, which says so by sending its empty groups too."""
        return _groups(self.share, bound)


@cache
def _groups(share: Fraction, bound: int) -> int:
    rule = Rule(1, share)
    n, d = share.numerator, share.denominator
    sizes = {max(1, bound * 2 // 3 * n // d), max(1, bound * n // d), bound}

    def enough(m: int) -> bool:
        for a in sizes:
            empty = m * (1 - 1 / m) ** a
            if m - empty - 5 * math.sqrt(min(empty, a * a / (2 * m))) < rule.differences(a, bound) + 1:
                return False
        return True

    low, high = rule.differences(bound, bound) + 2, 4 * bound + 4
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if enough(middle) else (middle + 1, high)
    return low


def signatures(sets: list[np.ndarray], rule: Rule) -> list[np.ndarray]:
    """Per set the hashes of its groups, in the class of each size that a linked set no smaller than it can
    have.  Empty groups are left out as long as more groups hold shingles than linked sets can differ in: if
    that is so for one of two sets, they share a group with shingles.  A class in which linked sets must be
    equal gets nothing."""
    bounds = rule.classes()
    out = []
    for own in sets:
        if not len(own):
            out.append(np.empty(0, np.uint64))
            continue
        most = len(own) * rule.share.denominator // rule.share.numerator
        first, last = np.searchsorted(bounds, [len(own), most])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        high = own >> np.uint64(32)
        parts = [np.empty(0, np.uint64)]
        for c in range(int(first), int(last) + 1):
            bound = int(bounds[c])
            differ = rule.differences(len(own), bound)
            if not differ:
                continue
            m = rule.groups(bound)
            # sorted hashes fall into the groups in order
            group = (high * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(group, minlength=m)
            end = np.cumsum(count)
            key = textscan.mix(total[end] - total[end - count] + textscan.mix((np.arange(m).astype(np.uint64) << np.uint64(8)) + np.uint64(c) + (count.astype(np.uint64) << np.uint64(40))))
            filled = count > 0
            parts.append(key[filled] if filled.sum() > differ else key)
        out.append(np.concatenate(parts))
    return out


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, bytes, n_shingles, two hashes of the set, the signatures and the point."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = textscan.text_bytes(batch.column("text"))
        n, one, two, keys, points = [], [], [], [], []
        for a, b in textscan.steps(offsets):
            sets = textscan.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORD, rule.size)
            n += map(len, sets)
            one += [int(textscan.mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            two += [int(np.bitwise_xor.reduce(textscan.mix(s + np.uint64(77))).astype(np.int64)) if len(s) else 0 for s in sets]
            keys += [k.view(np.int64) for k in signatures(sets, rule)]
            points += [point(s).tobytes() for s in sets]
        flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(flat))
        return pa.record_batch([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, pa.array(points, pa.binary())], ["doc_id", "bytes", "n_shingles", "one", "two", "keys", "point"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, bytes long, n_shingles long, one long, two long, keys array<long>, point binary")


def point(own: np.ndarray) -> np.ndarray:
    """Group counts, in bytes, over a power of two of groups that leaves a few shingles to each; of a set with
    a count that no byte holds, no coordinate at all, and so no bound."""
    n = COORDINATES
    while n * DENSITY < len(own):
        n *= 2
    counts = np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return counts.astype(np.uint8) if counts.max() < 256 else np.empty(0, np.uint8)


def matrix(points: list[bytes]) -> np.ndarray:
    """Points as rows over the fewest coordinates that one of them has: halves fold onto each other."""
    sizes = np.array(list(map(len, points)))
    fewest = int(sizes.min())
    out = np.zeros((len(points), fewest), np.uint16)
    for size in np.unique(sizes).tolist() if fewest else ():
        at = np.flatnonzero(sizes == size)
        rows = np.frombuffer(b"".join([points[i] for i in at.tolist()]), np.uint8).reshape(len(at), -1, fewest)
        out[at] = rows.sum(1, dtype=np.uint16) if size // fewest < 256 else np.minimum(rows.sum(1, dtype=np.int64), 65535)
    return out


class Tree:
    """An R-tree over points, packed by sorting on the coordinates of the greatest spread."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        spread = np.argsort(-points.var(0), kind="stable")[:2]
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], self.sizes)) if len(spread) > 1 else np.argsort(self.sizes)
        high, low = points[self.order], self.sizes[self.order]
        self.levels = []  # from the leaves up: greatest coordinates and least size in each box
        while True:
            starts = np.arange(0, len(low), FANOUT)
            high, low = np.maximum.reduceat(high, starts), np.minimum.reduceat(low, starts)
            self.levels.append((high, low))
            if len(low) == 1:
                break

    def partners(self, point: np.ndarray, size: int, rule: Rule) -> np.ndarray:
        """Points whose bound allows a link with this one."""
        if not len(point):
            return np.arange(len(self.points))
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low = self.levels[depth]
            at = at[np.minimum(high[at], point).sum(1, dtype=np.int64) >= rule.overlap(size + low[at])]
            width = len(self.levels[depth - 1][1]) if depth else len(self.order)
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1)
            at = at[at < width]
        found = self.order[at]
        return found[np.minimum(self.points[found], point).sum(1, dtype=np.int64) >= rule.overlap(size + self.sizes[found])]


def join_sets(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, known: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what is linked among sets (``side`` all 0) or between those of side 0 and 1, beyond
    what ``known`` components connect."""
    root = {int(i): int(i) for i in np.unique(known)}

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    crossing = bool(side.any())
    inner = np.flatnonzero(side == 0)
    points = matrix([point(x).tobytes() for x in sets])
    sizes = np.array(list(map(len, sets)))
    tree = Tree(points[inner], sizes[inner])
    flat = np.concatenate([sets[i] for i in inner])
    bounds = np.concatenate([[0], np.cumsum([len(sets[i]) for i in inner])])
    label = known.tolist()
    out = []
    for k in np.flatnonzero(side == 1) if crossing else np.arange(len(ids)):
        own = top(label[k])
        found = tree.partners(points[k], int(sizes[k]), rule)
        found = found[[inner[j] != k and (crossing or inner[j] < k) and top(label[inner[j]]) != own for j in found]] if len(found) else found
        if not len(found):
            continue
        lengths = bounds[found + 1] - bounds[found]
        at = np.repeat(bounds[found] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = shared(sets[k], flat[at], lengths)
        for j in inner[found[rule.links(both, len(sets[k]), lengths)]]:
            if top(label[j]) != top(label[k]):
                root[top(label[j])] = top(label[k])
                out.append((int(ids[k]), int(ids[j])))
    return out


def shared(own: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many shingles of each of several sets (one after the other, none empty) are in ``own``."""
    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
    return np.add.reduceat((own[place] == values).astype(np.int64), np.cumsum(lengths) - lengths)


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last of each run of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    begin = np.flatnonzero(new).tolist()
    return list(zip(begin, [*begin[1:], n], strict=True))


def stars(rows: DataFrame, rule: Rule) -> DataFrame:
    """(center, doc_id) of the documents whose point allows a link with their center's.  Rows are sorted by center,
    salt and document, so that the center's own come first; no more than these are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            center, salt, ids = (batch.column(c).to_numpy() for c in ("center", "salt", "doc_id"))
            points, sizes = batch.column("point").to_pylist(), batch.column("n_shingles").to_numpy()
            keep = np.zeros(len(ids), bool)
            for a, b in runs(center, salt):
                if (center[a], salt[a]) != current:
                    current, held = (center[a], salt[a]), []
                while a < b and ids[a] == center[a]:
                    held.append((points[a], int(sizes[a])))
                    a += 1
                for own, size in held if a < b else ():
                    every = matrix([own, *points[a:b]])
                    bound = np.minimum(every[1:], every[0]).sum(1, dtype=np.int64) if every.shape[1] else np.full(b - a, 2**62)
                    keep[a:b] |= bound >= rule.overlap(size + sizes[a:b])
            yield pa.record_batch([pa.array(center[keep]), pa.array(ids[keep])], ["center", "doc_id"])
        common.release()

    return rows.select("center", "salt", "doc_id", "n_shingles", "point").mapInArrow(run, "center long, doc_id long")


def star_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) links of centers with the documents dealt to them, from (center, salt, doc_id, text) sorted so that
    the center's own rows come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in common.slices(batches):
            data, offsets = textscan.text_bytes(batch.column("text"))
            center, salt, ids = (batch.column(c).to_numpy() for c in ("center", "salt", "doc_id"))
            linked = np.zeros(len(ids), bool)
            for a, b in textscan.steps(offsets):
                sets = textscan.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORD, rule.size)
                for s, e in runs(center[a:b], salt[a:b]):
                    if (center[a + s], salt[a + s]) != current:
                        current, held = (center[a + s], salt[a + s]), []
                    while s < e and ids[a + s] == center[a + s]:
                        held.append(sets[s])
                        s += 1
                    some = [i for i in range(s, e) if len(sets[i])]
                    for own in held if some else ():
                        if len(own):
                            lengths = np.array([len(sets[i]) for i in some])
                            both = shared(own, np.concatenate([sets[i] for i in some]), lengths)
                            linked[a + np.array(some)[rule.links(both, len(own), lengths)]] = True
            yield pa.record_batch([pa.array(center[linked]), pa.array(ids[linked])], ["a", "b"])
        common.release()

    return rows.select("center", "salt", "doc_id", "text").mapInArrow(run, "a long, b long")


def plausible(rows: DataFrame, rule: Rule) -> DataFrame:
    """(center, v, w, doc_id, block, component) of the rows that have a partner under the bound, not connected
    with them, in their pair of blocks; rows are sorted by gathering and pair of blocks, which are bounded."""
    names = ["center", "v", "w", "doc_id", "block", "component"]

    def fits(points: list[bytes], sizes: np.ndarray, component: np.ndarray, side: np.ndarray) -> np.ndarray:
        every, keep = matrix(points), np.zeros(len(points), bool)
        if len(points) <= 48:
            allowed = np.minimum(every[:, None], every[None]).sum(2, dtype=np.int64) >= rule.overlap(sizes[:, None] + sizes) if every.shape[1] else np.ones((len(points),) * 2, bool)
            allowed &= component[:, None] != component
            if side.any():
                allowed &= side[:, None] != side
            return allowed.any(1)
        crossing = bool(side.any())
        inner = np.flatnonzero(side == 0)
        if not len(inner):
            return keep
        tree = Tree(every[inner], sizes[inner])
        for k in np.flatnonzero(side == 1) if crossing else np.arange(len(points)):
            found = inner[tree.partners(every[k], int(sizes[k]), rule)]
            found = found[component[found] != component[k]]
            if len(found):
                keep[k] = True
                keep[found] = True
        return keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None

        def judge(part: pa.Table) -> pa.Table:
            columns = {c: part.column(c).to_numpy() for c in (*names, "n_shingles")}
            points = part.column("point").to_pylist()
            keep = np.zeros(len(points), bool)
            for a, b in runs(columns["center"], columns["v"], columns["w"]):
                side = ((columns["v"][a:b] != columns["w"][a:b]) & (columns["block"][a:b] == columns["w"][a:b])).astype(int)
                keep[a:b] = fits(points[a:b], columns["n_shingles"][a:b], columns["component"][a:b], side)
            return part.select(names).filter(pa.array(keep))

        for batch in batches:
            table = pa.Table.from_batches([batch]) if table is None else pa.concat_tables([table, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            last = runs(*(table.column(c).to_numpy() for c in ("center", "v", "w")))[-1][0]  # it may go on
            if last:
                yield from judge(table.slice(0, last)).to_batches()
                table = table.slice(last)
        if table is not None and table.num_rows:
            yield from judge(table).to_batches()
        table = None
        common.release()

    return rows.select(*names, "n_shingles", "point").mapInArrow(run, "center long, v int, w int, doc_id long, block int, component long")


def gatherings(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) links from rows sorted by gathering and pair of blocks: (center, v, w, doc_id, block, component, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        current = None
        links: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                v, w = current[1:]
                side = np.array([int(v != w and h[1] == w) for h in held])
                if v == w or 0 < side.sum() < len(side):
                    links.extend(join_sets(np.array([h[0] for h in held]), [h[3] for h in held], side, np.array([h[2] for h in held]), rule))
            held.clear()

        for batch in common.slices(batches):
            data, offsets = textscan.text_bytes(batch.column("text"))
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("center", "v", "w")), strict=True))
            ids, block, component = (batch.column(c).to_pylist() for c in ("doc_id", "block", "component"))
            for a, b in textscan.steps(offsets):
                for i, own in zip(range(a, b), textscan.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORD, rule.size), strict=True):
                    if keys[i] != current:
                        close()
                        current = keys[i]
                    if len(own):
                        held.append((ids[i], block[i], component[i], own))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
                links.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
        common.release()

    return rows.mapInArrow(run, "a long, b long")


def with_blocks(rows: DataFrame, weight: F.Column, most: int) -> DataFrame:
    """The rows with the number of blocks of their center, n.  Only centers with several are joined, and these are
    few: at most one in ``most`` of the rows."""
    sizes = rows.groupBy("center").agg(F.ceil(F.sum(weight) / most).cast("int").alias("n")).where(F.col("n") > 1)
    return rows.join(common.small(common.cut(sizes)), "center", "left").withColumn("n", F.coalesce("n", F.lit(1)))


def salted(rows: DataFrame, weight: F.Column, most: int) -> DataFrame:
    """(center, salt, doc_id): each center's documents dealt out by weight, the center itself to every salt."""
    dealt = with_blocks(rows, weight, most)
    own = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    every = F.when(F.col("doc_id") == F.col("center"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(own))
    return dealt.select("center", F.explode(every).alias("salt"), "doc_id")


def star_pairs(near: DataFrame, described: DataFrame, rule: Rule) -> DataFrame:
    """(center, doc_id): each document with the least center that its point allows a link with, and the centers."""
    rows = salted(near, F.lit(1), BLOCK_POINTS).join(described.select("doc_id", "n_shingles", "point").distinct(), "doc_id")
    rows = rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "doc_id")
    chosen = common.cut(stars(rows, rule).groupBy("doc_id").agg(F.min("center").alias("center")))
    return chosen.select("center", "doc_id").unionByName(chosen.select("center", F.col("center").alias("doc_id")).distinct())


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows with their documents' texts; only texts that are asked for move."""
    asked = common.small(common.cut(rows.select("doc_id").distinct()))
    return rows.join(texts.join(asked, "doc_id", "left_semi"), "doc_id")


def star_texts(pairs: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    weighed = pairs.join(members.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")), "doc_id")
    rows = with_texts(common.cut(salted(weighed, F.col("bytes"), BLOCK_BYTES)), texts)
    return rows.repartition("center", "salt").sortWithinPartitions("center", "salt", "doc_id")


def split(near: DataFrame, joined: DataFrame) -> DataFrame:
    """(center, doc_id, component) of the gatherings that aren't connected yet."""
    known = near.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = known.groupBy("center").agg(F.min("component").alias("first"), F.max("component").alias("last")).where(F.col("first") < F.col("last"))
    return common.cut(known.join(common.small(common.cut(several.select("center"))), "center"))


def pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """The rows of gatherings of n blocks, once for every pair of blocks (v, w) that theirs is in."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return dealt.withColumns({"v": F.least("block", "other"), "w": F.greatest("block", "other")}).drop("other", "n")


def blocks(rows: DataFrame, described: DataFrame) -> DataFrame:
    """Points of gatherings by pairs of blocks."""
    points = pairs_of_blocks(with_blocks(rows, F.lit(1), BLOCK_POINTS)).join(described.select("doc_id", "n_shingles", "point").distinct(), "doc_id")
    return points.repartition("center", "v", "w").sortWithinPartitions("center", "v", "w", "doc_id")


def gathered(rest: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents to be verified, with their texts, by pairs of blocks that are cut further where texts are long."""
    rows = rest.select("center", "doc_id", "component").distinct().join(members.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")), "doc_id")
    out = with_texts(common.cut(pairs_of_blocks(with_blocks(rows, F.col("bytes"), BLOCK_BYTES))), texts).select("center", "v", "w", "doc_id", "block", "component", "text")
    return out.repartition("center", "v", "w").sortWithinPartitions("center", "v", "w", "doc_id")


def least_with_key(keys: DataFrame) -> DataFrame:
    """(center, doc_id) for each key that several documents have: the least of them, with each.  Keys are exchanged once, as
    two numbers a row, and a window finds the least.  The commonest keys, which a sketch tells, stay out of it: of those
    a map-side aggregate finds the least, which is broadcast, so no task has all rows of one.  Which keys are told
    apart changes the way only, not the result."""
    told = keys.agg(F.expr(f"approx_top_k(key, {COMMON_KEYS}, {TRACKED_KEYS})").alias("top")).first()["top"] or []
    hot = F.col("key").isin([x["item"] for x in told if x["count"] > 1])
    same = Window.partitionBy("key")
    least, last = F.min("doc_id"), F.max("doc_id")
    rare = keys.where(~hot).withColumns({"center": least.over(same), "last": last.over(same)})
    centers = keys.where(hot).groupBy("key").agg(least.alias("center"), last.alias("last"))  # at most COMMON_KEYS rows
    common_ = keys.where(hot).join(F.broadcast(centers), "key")
    return rare.select("center", "last", "doc_id").unionByName(common_.select("center", "last", "doc_id")).where(F.col("center") < F.col("last")).select("center", "doc_id")


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.where(F.col("doc_id").isNotNull())
    described = common.cut(describe(docs, rule))
    equal = ["n_shingles", "one", "two"]
    heads = described.where(F.col("n_shingles") > 0).groupBy(*equal).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    several = common.cut(heads.where(F.col("copies") > 1).drop("copies"))
    own = common.join_few(described, several, equal, "left", "doc_id").withColumn("head", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")))
    members = common.cut(own.select("doc_id", "bytes", "n_shingles", "head"))
    copies = members.where(F.col("head") != F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    keys = own.where(F.col("head") == F.col("doc_id")).select("doc_id", F.explode("keys").alias("key"))
    near = least_with_key(keys)
    near = common.cut(near.select("center", "doc_id").distinct())
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    linked = common.cut(star_links(star_texts(star_pairs(near, described, rule), members, texts), rule).unionByName(copies))
    joined = components(linked)
    rest = plausible(blocks(split(near, joined), described), rule)
    links = gatherings(gathered(common.cut(rest), members, texts), rule)
    # a component of the first round is one node of the second
    whole = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).where(F.col("a") != F.col("b"))
    found = components(whole.unionByName(links))
    per_doc = members.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return per_doc.join(found, per_doc["doc_id"] == found["node"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows, with all their columns, but for those of documents that aren't the least of their class."""
    gone = common.small(common.cut(classes(docs, rule).where(F.col("component_id") < F.col("doc_id")).select("doc_id")))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
