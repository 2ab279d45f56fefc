"""Token ids as files of patched frame-of-reference blocks.

A segment holds consecutive documents.  Their ids are cut into blocks of ``BLOCK``; a block stores its least
id, the differences packed at a width that a percentile of them fits in, and the differences that do not fit
in an exception list (place and value).  The width is the one among the percentiles' that costs fewest bits.
The header has the documents' ids and lengths and where each block starts, so that a reader can go to any
document without unpacking what comes before.

Segment, little-endian: magic ``PFR1``; u32 number of documents, ids and blocks; i64 document ids; u32 ids of
each document; u32 start of each block after the index, and the end of the last; the blocks.  Block: u32 least
id, u8 width, u8 number of exceptions, the packed differences, u8 places, u32 values.

The files are Spark's: one row a segment, in a Parquet container without further compression, so they are
written with Spark's commit protocol to any store that it knows.

Defined cases: a null or empty text has only the end id; repeated ids keep all their rows, next to each
other; a null document id sorts first and is read back as null; an empty table gives empty files; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import atoms, common

BLOCK, SEGMENT_IDS, MAGIC = 128, 200_000, b"PFR1"
PERCENTILES = (100, 99, 97, 94, 90, 80)
BITS = np.ceil(np.log2(np.arange(65536) + 1)).astype(np.uint8)
NO_ID = np.int64(-(2**63))


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of values, one after the other, and their sizes in bytes."""
    n = -(-len(values) // BLOCK)
    padded = np.full(n * BLOCK, values[-1] if n else 0, np.uint32)
    padded[: len(values)] = values
    rows = padded.reshape(n, BLOCK)
    least = rows.min(1) if n else np.empty(0, np.uint32)
    rows = rows - least[:, None]
    needs = BITS[np.minimum(rows, 65535)]
    if n and rows.max() > 65535:
        needs = np.where(rows > 65535, np.ceil(np.log2(rows.astype(np.float64) + 1)), needs).astype(np.uint8)
    ordered = np.sort(needs, 1)
    best, width = np.full(n, 2**62), np.zeros(n, np.int64)
    for percentile in PERCENTILES:
        bits = ordered[:, BLOCK * percentile // 100 - 1].astype(np.int64)
        cost = bits * BLOCK + (needs > bits[:, None]).sum(1) * 40
        width, best = np.where(cost < best, bits, width), np.minimum(cost, best)
    over = needs > width[:, None]
    count = over.sum(1)
    sizes = 6 + BLOCK * width // 8 + 5 * count
    start = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    out[start[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[start + 4], out[start + 5] = width, count
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        low = rows[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4)[:, :, : -(-w // 8)]  # the bytes that have these bits
        bits = np.unpackbits(low, axis=2, bitorder="little")[:, :, :w]
        out[(start[at] + 6)[:, None] + np.arange(BLOCK * w // 8)] = np.packbits(bits.reshape(len(at), BLOCK * w), axis=1, bitorder="little")
    block, place = np.nonzero(over)
    if len(block):
        rank = np.arange(len(block)) - (np.cumsum(count) - count)[block]
        first = start[block] + 6 + BLOCK * width[block] // 8
        out[first + rank] = place
        out[(first + count[block] + 4 * rank)[:, None] + np.arange(4)] = rows[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), sizes


def unpack(payload: memoryview, starts: np.ndarray, count: int) -> np.ndarray:
    """The values of the blocks that start at ``starts`` (which ends with the end of the last)."""
    n = len(starts) - 1
    raw = np.frombuffer(payload, np.uint8)
    out = np.zeros((n, BLOCK), np.uint32)
    widths = raw[starts[:-1] + 4] if n else np.empty(0, np.uint8)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        packed = raw[starts[at][:, None] + 6 + np.arange(BLOCK * w // 8)]
        bits = np.zeros((len(at), BLOCK, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
        out[at] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
    for i in np.flatnonzero(raw[starts[:-1] + 5]).tolist() if n else ():
        k, a = int(raw[starts[i] + 5]), int(starts[i]) + 6 + BLOCK * int(widths[i]) // 8
        out[i, raw[a : a + k]] = np.frombuffer(raw[a + k : a + 5 * k].tobytes(), "<u4")
    if n:
        out += np.frombuffer(raw[starts[:-1][:, None] + np.arange(4)].tobytes(), "<u4")[:, None]
    return out.reshape(-1)[:count]


def write_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, sizes = pack(ids)
    index = np.concatenate([[0], np.cumsum(sizes)]).astype("<u4")
    head = np.array([len(doc_ids), len(ids), len(sizes)], "<u4")
    return b"".join((MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), index.tobytes(), blocks))


def read_segment(data: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and ids (flat) of the documents from ``first`` to before ``last`` in the segment;
    only the blocks that they touch are unpacked."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    docs, ids, blocks = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u4", blocks + 1, at + 12 * docs).astype(np.int64)
    payload = memoryview(data)[at + 12 * docs + 4 * (blocks + 1) :]
    last = docs if last is None else last
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    a, b = int(bounds[first]), int(bounds[last])
    k = a // BLOCK
    values = unpack(payload, index[k : -(-b // BLOCK) + 1], min(ids - k * BLOCK, (-(-b // BLOCK) - k) * BLOCK)) if b > a else np.empty(0, np.uint32)
    return doc_ids[first:last], lengths[first:last], values[a - k * BLOCK : b - k * BLOCK]


class Encoder:
    """The library's ids of each text, by atoms, which its words never cross."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memory = atoms.Memory(2 * atoms.GENERATION_BYTES)  # the library is the dearest step here, and nothing else holds much
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        ends = {i for t, i in spec["model"]["vocab"].items() if suffix and t.endswith(suffix)}
        self.ends = np.array([i in ends for i in range(max(spec["model"]["vocab"].values()) + 1)]) if ends else None

    def encoded(self, texts: pa.Array) -> Iterator[atoms.Texts]:
        return atoms.encoded(texts, self.memory, self.learn)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, as little-endian unsigned 32-bit integers."""
        out = []
        for step in self.encoded(pa.array(texts, pa.large_string())):
            ids, at = step.ids()
            out += [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    def learn(self, parts: list[str]) -> list[bytes]:
        """Atoms of letters are one word each, so they go through the library many at a time, and their ids end
        where a word-end token stands; other atoms go one by one."""
        out: list[bytes | None] = [None] * len(parts)
        letters = [i for i, p in enumerate(parts) if self.ends is not None and p.isalpha()]
        for a in range(0, len(letters), 2_000):
            some = letters[a : a + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([parts[i] for i in some])], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                raw, bounds = ids.tobytes(), [0, *(4 * last).tolist()]
                for i, x, y in zip(some, bounds, bounds[1:], strict=False):
                    out[i] = raw[x:y]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, found in zip(rest, self.tokenizer.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out


@cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """All texts' ids, each text's followed by ``end_id``, in ascending order of doc_id over the parts and
    segments of the files at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # document ids, lengths, ids
        size = 0

        def segment() -> pa.RecordBatch:
            keys, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_ids": len(ids), "segment": write_segment(keys, lengths, ids)}], pa.schema({"part": pa.int32(), "seq": pa.int32(), "n_ids": pa.int64(), "segment": pa.binary()}))

        for batch in common.slices(batches, most=2_000_000):
            keys, done = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(), 0
            for step in own.encoded(batch.column("text")):
                ids, at = step.ids()
                n = len(at) - 1
                closed = np.insert(ids, at[1:], end_id).astype(np.uint32)
                bounds = at + np.arange(n + 1)
                a = 0
                while a < n:  # a segment is full with the document that reaches its size
                    b = min(n, int(np.searchsorted(bounds, bounds[a] + SEGMENT_IDS - size, "left")))
                    held.append((keys[done + a : done + b], np.diff(bounds[a : b + 1]), closed[bounds[a] : bounds[b]]))
                    size += int(bounds[b] - bounds[a])
                    if size >= SEGMENT_IDS:
                        yield segment()
                        held, size, seq = [], 0, seq + 1
                    a = b
                done += n
        if held:
            yield segment()
        common.release()

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, seq int, n_ids long, segment binary").write.option("compression", "none").mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 from the files."""
    rows = spark.read.parquet(path)
    sizes = rows.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", "seq", F.coalesce(inner, F.lit(0)).alias("inner")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("segment"):
                doc_ids, lengths, ids = read_segment(data.as_py())
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                at = batch.column("part")[0].as_py(), batch.column("seq")[0].as_py()
                n = len(doc_ids)
                yield pa.record_batch([pa.array(np.full(n, at[0], np.int32)), pa.array(np.full(n, at[1], np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(bounds[:-1]), pa.array(lengths), pa.array(sums, pa.int64())], ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch.slice(i, 1) for i in range(batch.num_rows))

    found = rows.select("part", "seq", "segment").mapInArrow(one_by_one, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
