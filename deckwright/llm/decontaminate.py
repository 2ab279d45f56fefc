"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a slice of documents.  Words outside the benchmark's vocabulary can be part of no occurrence, so a
shard's sequence holds only its runs of vocabulary words, each run closed by its own end mark.  Over the
Burrows-Wheeler transform of this sequence stands a wavelet matrix; all test phrases are searched backwards
at once by its ranks, occurrences are located by walking to sampled suffix positions, and the words that they
cover are merged into spans.

Phrases are the windows of ``size`` consecutive words of each item, or the whole item if it has fewer words.
Items come in blocks of bounded bytes, each built on the driver, broadcast and searched in turn.  A worker keeps
the blocks that it has opened, so all of a benchmark is in its memory: ``MAX_BYTES`` of text is the checked bound.

Defined cases: a null or empty text has no words and is hit by nothing; an item without words is none; an
item id that repeats is one item with several texts; repeated rows are judged alike; an empty benchmark hits
nothing; other columns of the input are ignored, or kept by :func:`remove`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

WORD = textscan.byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")[textscan.LOWER]
#: Words of a window; bytes of benchmark text in a block; distance of sampled suffix positions.
SIZE, BLOCK_BYTES, SAMPLE = 10, 8_000_000, 16
#: Bytes of benchmark text beyond which this refuses to broadcast it.
MAX_BYTES = 64_000_000


@dataclass(frozen=True)
class Phrases:
    """Distinct phrases as rows of vocabulary numbers from 1, right-aligned (0: none), and their items."""

    vocabulary: np.ndarray  # sorted hashes of words
    rows: np.ndarray
    lengths: np.ndarray
    item_offsets: np.ndarray
    items: np.ndarray  # numbers into names
    names: list[str]


def phrases(items: pa.Table, size: int = SIZE) -> Phrases:
    """From item_id (string) and text."""
    data, offsets = textscan.text_bytes(items.column("text"))
    words, at = textscan.word_hashes(data, offsets, WORD)
    vocabulary, numbers = np.unique(words, return_inverse=True)
    names = sorted(set(items.column("item_id").to_pylist()))
    number = {name: i for i, name in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, a, b in zip(items.column("item_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        for k in range(a, max(b - size, a) + 1) if b > a else ():
            found.setdefault(tuple((numbers[k : min(k + size, b)] + 1).tolist()), set()).add(number[item])
    rows = np.zeros((len(found), size), np.int64)
    for i, phrase in enumerate(found):
        rows[i, size - len(phrase) :] = phrase
    owners = [sorted(x) for x in found.values()]
    return Phrases(vocabulary, rows, (rows > 0).sum(1), np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64), np.array([i for x in owners for i in x], np.int64), names)


class WaveletMatrix:
    """Ranks and symbols of a sequence, for arrays of positions at once."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bits = (sequence >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[~bits], sequence[bits]])
        everything = np.arange(symbols)
        self.starts = self.descend(everything, np.zeros(symbols, np.int64))

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ones[at]
            at = np.where(symbols >> level & 1, zeros + one, at - one)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self.descend(symbols, at) - self.starts[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at positions, and how often each stands before."""
        symbols = np.zeros(len(at), np.int64)
        for level, ones, zeros in zip(range(self.levels - 1, -1, -1), self.ones, self.zeros, strict=True):
            one = ones[at]
            bit = ones[at + 1] > one
            symbols |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + one, at - one)
        return symbols, at - self.starts[symbols]


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of which every end mark (0) counts as different, by prefix doubling."""
    marks = np.flatnonzero(sequence == 0)
    rank = sequence + len(marks)
    rank[marks] = np.arange(len(marks))
    step = 1
    while True:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = new
        step *= 2
        if new[-1] == len(order) - 1 or step >= len(order):
            return order


class FMIndex:
    """Over a sequence of symbols from 1 in which each run ends with 0."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        order = suffix_order(sequence)
        self.matrix = WaveletMatrix(sequence[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=symbols))])[:-1]
        # a run's first position is sampled too: no walk goes through an end mark, whose order is its own
        sampled = (order % SAMPLE == 0) | (sequence[order - 1] == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]
        self.length = len(sequence)

    def search(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The phrases that occur, and the bounds of each in the suffix order."""
        at = np.arange(len(rows))
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.length, np.int64)
        for column in range(rows.shape[1] - 1, -1, -1):
            symbol = rows[at, column]
            more = symbol > 0
            s = symbol[more]
            low[more] = self.first[s] + self.matrix.rank(s, low[more])
            high[more] = self.first[s] + self.matrix.rank(s, high[more])
            left = low < high
            at, low, high = at[left], low[left], high[left]
            if not len(at):
                break
        return at, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these ranks start."""
        out = np.empty(len(rows), np.int64)
        at, open_, steps = rows.copy(), np.arange(len(rows)), 0
        while len(open_):
            hit = self.sampled[at + 1] > self.sampled[at]
            out[open_[hit]] = self.positions[self.sampled[at[hit]]] + steps
            open_, at = open_[~hit], at[~hit]
            symbols, before = self.matrix.access(at)
            at, steps = self.first[symbols] + before, steps + 1
        return out


def find(words: np.ndarray, at: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Which words (hashes; ``at`` has the documents' offsets) an occurrence covers, and the distinct pairs of
    document and item as rows."""
    hit, none = np.zeros(len(words), bool), np.empty((0, 2), np.int64)
    if not len(block.rows) or not len(words):
        return hit, none
    place = np.minimum(np.searchsorted(block.vocabulary, words), len(block.vocabulary) - 1)
    symbol = np.where(block.vocabulary[place] == words, place + 1, 0)
    known = symbol > 0
    edge = np.zeros(len(words) + 1, bool)
    edge[at] = True
    begin = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = end - begin >= block.lengths.min()
    begin, end = begin[long], end[long]
    if not len(begin):
        return hit, none
    sizes = end - begin + 1  # with the mark
    start = np.cumsum(sizes) - sizes
    origin = np.repeat(begin - start, sizes) + np.arange(sizes.sum())
    sequence = symbol[np.minimum(origin, len(symbol) - 1)]
    sequence[start + sizes - 1] = 0
    index = FMIndex(sequence, len(block.vocabulary) + 1)
    which, low, high = index.search(block.rows)
    if not len(which):
        return hit, none
    count = high - low
    row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    which = np.repeat(which, count)
    first = origin[index.locate(row)]
    cover = np.bincount(first, minlength=len(words) + 1) - np.bincount(first + block.lengths[which], minlength=len(words) + 1)
    hit = np.cumsum(cover)[:-1] > 0
    pair = np.unique(np.stack([np.searchsorted(at, first, "right") - 1, which], 1), axis=0)
    owners = block.item_offsets[pair[:, 1] + 1] - block.item_offsets[pair[:, 1]]
    item = np.repeat(block.item_offsets[pair[:, 1]] - (np.cumsum(owners) - owners), owners) + np.arange(owners.sum())
    return hit, np.unique(np.stack([np.repeat(pair[:, 0], owners), block.items[item]], 1), axis=0)


def blocks(benchmark: DataFrame, size: int = SIZE) -> list[Broadcast]:
    """The benchmark's phrases in blocks of about ``BLOCK_BYTES`` of text."""
    rows = benchmark.where(F.octet_length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > MAX_BYTES:
        raise ValueError(f"a benchmark of {total} bytes is more than {MAX_BYTES}: search its parts one after the other")
    n = -(-total // BLOCK_BYTES)
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(phrases(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow(), size)) for i in range(n)]


def search(texts: pa.Array, parts: list[Broadcast]) -> Iterator[tuple[int, int, np.ndarray, list[set[str]], np.ndarray, np.ndarray, np.ndarray]]:
    """For slices a to b of the texts: hit flags of the words, item names of each text, the words' bounds in
    the slice's bytes, and the texts' offsets in the words."""
    data, offsets = textscan.text_bytes(texts)
    for a, b in textscan.steps(offsets, 2_000_000):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, bounds = textscan.word_hashes(own, at, WORD)
        starts, ends, _ = textscan.word_spans(own, at, WORD)
        hit, names = np.zeros(len(hashes), bool), [set() for _ in range(a, b)]
        for part in parts:
            more, pairs = find(hashes, bounds, part.value)
            hit |= more
            for doc, item in pairs.tolist():
                names[doc].add(part.value.names[item])
        yield a, b, hit, names, starts, ends, bounds


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the covered words as spans."""
    parts = blocks(benchmark, size)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for _, _, hit, names, _, _, bounds in search(batch.column("text"), parts):
            total = np.concatenate([[0], np.cumsum(hit)])
            out[0] += np.diff(bounds).tolist()
            out[1] += (total[bounds[1:]] - total[bounds[:-1]]).tolist()
            out[2] += map(len, names)
            out[3] += [sha256(",".join(sorted(x)).encode()).hexdigest() for x in names]
            out[4] += [[{"first": s, "last": e - 1} for s, e in spans(hit[p:q])] for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), kind), strict=True)]
        return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans"])

    found = common.map_batches(docs.select("doc_id", "text"), each, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, spans array<struct<first:long,last:long>>")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and one past the last of each run of set flags."""
    if not flags.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def remove(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows, with all their columns, each covered span of the text replaced by a line break, again until
    nothing is covered.  ``n_chars``, if there is one, follows the text."""
    parts = blocks(benchmark, size)
    names = docs.columns

    def clean(texts: pa.Array) -> list[str | None]:
        out: list[str | None] = texts.to_pylist()
        todo = list(range(len(out)))
        while todo:
            again = []
            some = pa.array([out[i] for i in todo], pa.large_string())
            for a, b, hit, _, starts, ends, bounds in search(some, parts):
                whole = np.concatenate([[0], np.cumsum([len((out[todo[k]] or "").encode()) for k in range(a, b)])])
                for k in range(a, b):
                    p, q = bounds[k - a], bounds[k - a + 1]
                    found = spans(hit[p:q])
                    if found:
                        raw, base, pieces, last = (out[todo[k]] or "").encode(), whole[k - a], [], 0
                        for s, e in found:
                            pieces.append(raw[last : starts[p + s] - base])
                            last = ends[p + e - 1] - base
                        out[todo[k]] = b"\n".join([*pieces, raw[last:]]).decode()
                        again.append(todo[k])
            todo = again
        return out

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = clean(batch.column("text"))
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(texts, batch.column("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
        return pa.record_batch(list(columns.values()), list(columns))

    return common.map_batches(docs, each, docs.schema)
