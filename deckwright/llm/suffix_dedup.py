"""Removal of long byte strings that an earlier document has too, by suffix arrays of shards.

A string of ``LENGTH`` bytes is judged by where its copies are, so copies must meet in one shard.  Each such
string has an anchor, the ``ANCHOR``-gram in it with the least hash; consecutive strings mostly share theirs.

1. Anchors are exchanged as small hashes, and those within one document only are done with.
2. What is left of a document, strings grouped by anchor as fragments of text, goes to the shard of the anchor.
3. A shard's suffix array comes from external induced sorting (:mod:`.induced_sort`) with common-prefix values;
   suffixes that share ``LENGTH`` bytes are one string, and it belongs to its least document.
4. Each document learns which of its strings an earlier one has, and loses the bytes that they cover.

Whole texts that are equal are found first, so only the least of them takes part.  Anchors that many documents of
a task share are known to be shared there and are exchanged once a task.  Of equal fragments each part of the
documents sends only its least document's to the shard, and the others lose theirs at once, so a shard gets a
passage of very many documents once a part.  Fragments that reach over the ends of such a passage differ from
document to document, and all of them meet in its shard.

Defined cases: a null text has no bytes; texts shorter than ``LENGTH`` bytes lose nothing; rows with one id don't
take from each other, and each loses what an earlier id has of its own text; a null id counts as less than every other; an empty table
gives an empty result; other columns of the input are ignored, or kept by :func:`remove`.  Where a removal cuts
a character in two, :func:`remove` drops the rest of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced_sort, textscan

LENGTH, ANCHOR = 50, 20
#: Bytes of all texts for one shard, and for one part of the documents.
SHARD_BYTES, PART_BYTES = 3_000_000, 10_000_000
NO_ID = -(2**63)


def fragments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per run of strings with one anchor: the text, where the first string starts in it, how many strings
    there are, and a hash of the anchor."""
    width, n = length - anchor + 1, len(data) - anchor + 1
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64)
    prefix = textscan.prefix_hash(data)
    code = (prefix[anchor:] - prefix[:-anchor]) * textscan.power_table(textscan._P_INV, n)
    least = (code * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32) << np.uint64(32)
    least |= np.arange(n, dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    start = np.arange(len(least))
    inside = start + length <= offsets[1:][owner]
    start, owner, at = start[inside], owner[inside], (least[inside] & np.uint64(2**32 - 1)).astype(np.int64)
    if not len(start):
        return none, none, none, none.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return owner[first], start[first] - offsets[owner[first]], count, textscan.mix(code[at[first]])


def shared_within(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have a key that entries of another document have, and the first entry of each key."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    end = np.concatenate([start[1:], [len(k)]]).astype(np.int64) if len(k) else start
    several = d[start] != d[end - 1] if len(k) else np.empty(0, bool)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(several, end - start)
    return out, order[start]


def part_of(rows: np.ndarray, parts: int) -> np.ndarray:
    return (textscan.mix(rows.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def packed(**columns: np.ndarray) -> dict[str, bytes]:
    return {k: v.tobytes() for k, v in columns.items()}


def joined(table: pa.Table, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)


ANCHORS = "kind int, key int, rows binary, starts binary, counts binary, codes binary"
ANCHOR_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int32()), *((c, pa.binary()) for c in ("rows", "starts", "counts", "codes"))])


def anchors(texts: DataFrame, shards: int, parts: int, length: int, anchor: int) -> DataFrame:
    """Kind 0, to be compared by shard: an entry for each anchor.  Kind 1, already known to be shared, by part
    of the documents.  An entry: row (a hash of id and text), where its strings start, their number, code (shard
    and hash)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = textscan.text_bytes(batch.column("text"))
        own = batch.column("row").to_numpy(zero_copy_only=False)
        found: list[list[np.ndarray]] = [[], [], [], []]
        for a, b in textscan.steps(offsets):
            doc, start, count, code = fragments(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, anchor)
            for to, x in zip(found, (own[a + doc], start.astype(np.int32), count.astype(np.uint8), code), strict=True):
                to.append(x)
        keys, starts, counts, codes = (np.concatenate(x) for x in found)
        rows = []
        known, first = shared_within(codes, keys)
        shard = ((codes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        send = ~known
        send[first] = True
        for kind, chosen, key in ((0, np.flatnonzero(send), shard), (1, np.flatnonzero(known), part_of(keys, parts))):
            chosen = chosen[np.argsort(key[chosen], kind="stable")]
            heads = np.flatnonzero(np.concatenate([[True], np.diff(key[chosen]) != 0])) if len(chosen) else []
            for some in np.split(chosen, heads[1:]) if len(chosen) else []:
                code = codes[some].astype(np.uint32) if kind == 0 else shard[some]
                rows.append({"kind": kind, "key": int(key[some[0]])} | packed(rows=keys[some], starts=starts[some], counts=counts[some], codes=code))
        return pa.RecordBatch.from_pylist(rows, ANCHOR_SCHEMA)

    return common.map_batches(texts, each, ANCHORS)


def compare(parts: int) -> object:
    """Per shard the entries whose hash another document has, by part of the documents; an entry's code is
    the shard."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == 1:
            return table.select(ANCHOR_SCHEMA.names)
        shard = table.column("key")[0].as_py()
        keys, starts, counts = joined(table, "rows", "<i8"), joined(table, "starts", "<i4"), joined(table, "counts", np.uint8)
        chosen = np.flatnonzero(shared_within(joined(table, "codes", "<u4"), keys)[0])
        key = part_of(keys[chosen], parts)
        chosen, key = chosen[np.argsort(key, kind="stable")], np.sort(key)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0])) if len(chosen) else []
        rows = [{"kind": 1, "key": int(part_of(keys[s[:1]], parts)[0])} | packed(rows=keys[s], starts=starts[s], counts=counts[s], codes=np.full(len(s), shard, np.int32)) for s in (np.split(chosen, heads[1:]) if len(chosen) else [])]
        return pa.Table.from_pylist(rows, ANCHOR_SCHEMA)

    return run


FRAGMENTS = "shard int, rows binary, ids binary, starts binary, counts binary, bytes binary"


def cut_fragments(parts: int, length: int) -> object:
    """Per part of the documents: their shared entries with the bytes, by shard; and, as shard -1 - part and
    without bytes, those of which the part already has an equal fragment in an earlier document."""

    def run(entries: pa.Table, texts: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "starts", "counts", "bytes"))])
        keys, starts, counts, shard = (joined(entries, c, t) for c, t in (("rows", "<i8"), ("starts", "<i4"), ("counts", np.uint8), ("codes", "<i4")))
        if not len(keys) or not texts.num_rows:
            return schema.empty_table()
        data, offsets = textscan.text_bytes(texts.column("text"))
        own, all_ids = texts.column("row").to_numpy(), texts.column("doc_id").to_numpy()
        # should two rows have one hash, an entry is cut from each, as any string is judged by itself
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], keys, "left"), np.searchsorted(own[order], keys, "right")
        entry = np.repeat(np.arange(len(keys)), high - low)
        row = order[np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low) + np.arange(len(entry))]
        start, size = starts[entry].astype(np.int64), counts[entry].astype(np.int64) + length - 1
        fits = start + size <= offsets[row + 1] - offsets[row]
        entry, start, size, row = entry[fits], start[fits], size[fits], row[fits]
        ids = all_ids[row]
        by = np.lexsort((start, keys[entry], shard[entry]))
        entry, start, size, row, ids = entry[by], start[by], size[by], row[by], ids[by]
        # of equal fragments only the least document's goes to the shard: the others lose all of theirs to it
        raw, begin, number = data.tobytes(), offsets[row] + start, {}
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)], np.int64)
        least = np.full(len(number), 2**63 - 1)
        del raw, number
        np.minimum.at(least, which, ids)
        lost = ids > least[which]
        out = []
        if lost.any():
            e = entry[lost]
            part = int(part_of(keys[:1], parts)[0])
            out.append({"shard": -1 - part} | packed(rows=keys[e], ids=ids[lost], starts=starts[e], counts=counts[e], bytes=np.empty(0, np.uint8)))
        entry, start, size, row, ids = entry[~lost], start[~lost], size[~lost], row[~lost], ids[~lost]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(shard[entry]) != 0])) if len(entry) else []
        for some in np.split(np.arange(len(entry)), heads[1:]) if len(entry) else []:
            e, n = entry[some], size[some]
            at = np.repeat(offsets[row[some]] + start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append({"shard": int(shard[e[0]])} | packed(rows=keys[e], ids=ids[some], starts=starts[e], counts=counts[e], bytes=data[at]))
        return pa.Table.from_pylist(out, schema)

    return run


MARKS = "part int, rows binary, ids binary, starts binary, ends binary"


def sort_shard(parts: int, length: int) -> object:
    """Per shard: ranges of strings that an earlier document has, by part of the documents."""
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("rows", "ids", "starts", "ends"))])

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, ids, starts, counts = joined(table, "rows", "<i8"), joined(table, "ids", "<i8"), joined(table, "starts", "<i4").astype(np.int64), joined(table, "counts", np.uint8).astype(np.int64)
        if shard < 0:
            return pa.Table.from_pylist([{"part": -1 - shard} | packed(rows=keys, ids=ids, starts=starts, ends=starts + counts + length - 1)], schema)
        raw = b"".join(table.column("bytes").to_pylist())
        del table
        bounds = np.concatenate([[0], np.cumsum(counts + length - 1)])
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        least = np.full(len(number), 2**63 - 1)
        np.minimum.at(least, which, ids)
        sizes = np.array(list(map(len, number)))
        # fragments one after the other, each followed by 1, and all by 0
        body = np.frombuffer(b"\0".join(number), np.uint8)
        del raw, number
        sequence = np.concatenate([body.astype(np.uint16) + 2, np.array([1, 0], np.uint16)])
        heads = np.cumsum(sizes + 1) - (sizes + 1)
        sequence[heads[1:] - 1] = 1
        del body
        # of the strings' starts; none starts in a fragment's last bytes and the mark after it, nor at the end
        owner = np.full((len(sizes), 2), -1, np.int32)
        owner[:, 0] = np.arange(len(sizes))
        owner = np.append(np.repeat(owner.reshape(-1), np.stack([sizes - length + 1, np.full(len(sizes), length)], 1).reshape(-1)), np.int32(-1))
        first = np.full(len(sequence), 2**63 - 1)

        def consume(positions: np.ndarray, value: np.ndarray) -> None:
            group = np.flatnonzero(value < length)
            of = np.where(owner[positions] >= 0, least[np.maximum(owner[positions], 0)], 2**63 - 1)
            first[positions] = np.repeat(np.minimum.reduceat(of, group), np.diff(np.concatenate([group, [len(positions)]])))

        induced_sort.sort(sequence, length, consume)
        del sequence, owner
        # every occurrence's strings again, and which of them are someone else's
        n = counts
        entry = np.repeat(np.arange(len(ids)), n)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        lost = first[heads[which[entry]] + inner] < ids[entry]
        edge = np.concatenate([[True], entry[1:] != entry[:-1]])
        begin = np.flatnonzero(lost & (edge | ~np.concatenate([[False], lost[:-1]])))
        end = np.flatnonzero(lost & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([lost[1:], [False]])))
        own, doc, a, b = keys[entry[begin]], ids[entry[begin]], starts[entry[begin]] + inner[begin], starts[entry[begin]] + inner[end] + length
        key = part_of(own, parts)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rows = [{"part": int(key[s[0]])} | packed(rows=own[s], ids=doc[s], starts=a[s], ends=b[s]) for s in np.split(order, cuts) if len(s)]
        return pa.Table.from_pylist(rows, schema)

    return run


def merge(table: pa.Table) -> pa.Table:
    """Per part: each row's removed ranges of bytes, merged."""
    rows, ids, a, b = joined(table, "rows", "<i8"), joined(table, "ids", "<i8"), joined(table, "starts", "<i8"), joined(table, "ends", "<i8")
    order = np.lexsort((a, ids, rows))
    rows, ids, a, b = rows[order], ids[order], a[order], b[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])]))
    out = []
    for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(ids)], strict=True):
        reach = np.maximum.accumulate(b[s:e])
        new = np.flatnonzero(np.concatenate([[True], a[s + 1 : e] > reach[:-1]]))
        out.append((int(rows[s]), int(ids[s]), a[s + new].tobytes(), reach[np.concatenate([new[1:] - 1, [e - s - 1]])].tobytes()))
    return pa.table({"row": pa.array([x[0] for x in out], pa.int64()), "doc_id": pa.array([x[1] for x in out], pa.int64()), "starts": pa.array([x[2] for x in out], pa.binary()), "ends": pa.array([x[3] for x in out], pa.binary())})


def row_key(doc_id: F.Column, text: F.Column) -> F.Column:
    return F.xxhash64(doc_id, text)


def lost_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, starts, ends): the byte ranges that each row loses to earlier documents; and (doc_id, same): the
    digest of the text of documents that lose all of it to an equal, earlier one."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(F.octet_length("text") >= length)
    digests = common.cut(rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("same"), F.octet_length("text").alias("n")))
    total = digests.agg(F.sum("n")).first()[0] or 0
    shards, parts = max(1, -(-total // SHARD_BYTES)), max(1, -(-total // PART_BYTES))
    heads = digests.groupBy("same").agg(F.min("doc_id").alias("head"), F.count("*").alias("copies")).where(F.col("copies") > 1).drop("copies")
    copies = common.join_few(digests.select("doc_id", "same"), common.cut(heads), ["same"], "inner", "doc_id")
    copies = common.cut(copies.where(F.col("doc_id") > F.col("head")).select("doc_id", "same").distinct())
    # of rows with one id only the text that has an earlier equal is a copy, so both columns say which row goes
    marked = rows.withColumn("same", F.md5(F.col("text").cast("binary"))).join(common.small(copies), ["doc_id", "same"], "left_anti").select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    shared = anchors(marked, shards, parts, length, anchor).groupBy("kind", "key").applyInArrow(common.released(compare(parts)), ANCHORS)
    dealt = marked.mapInArrow(with_part(parts), "part int, row long, doc_id long, text string")
    pieces = shared.withColumnRenamed("key", "part").groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(common.released(cut_fragments(parts, length)), FRAGMENTS)
    marks = pieces.groupBy("shard").applyInArrow(common.released(sort_shard(parts, length)), MARKS)
    return common.cut(marks.groupBy("part").applyInArrow(common.released(merge), "row long, doc_id long, starts binary, ends binary")), copies


def with_part(parts: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(part_of(rows, parts)), *batch.columns], ["part", "row", "doc_id", "text"])

    return run


def with_ranges(docs: DataFrame, length: int, anchor: int) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` with three more columns, and the names of these, which none of theirs has: starts and
    ends of the lost ranges (null: none), and whether all is lost to an equal text."""
    ranges, copies = lost_ranges(docs, length, anchor)
    free = [f"c{i}" for i in range(len(docs.columns) + 6) if f"c{i}" not in {c.lower() for c in docs.columns}]
    key, same, row, copy, starts, ends = free[:6]
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), same: F.md5(text.cast("binary"))})
    out = out.withColumn(row, row_key(F.col(key), text))
    out = out.join(common.small(copies.select(F.col("doc_id").alias(key), F.col("same").alias(same), F.lit(True).alias(copy))), [key, same], "left")
    found = ranges.select(F.col("row").alias(row), F.col("doc_id").alias(key), F.col("starts").alias(starts), F.col("ends").alias(ends))
    return out.join(common.small(found), [row, key], "left").select(*docs.columns, copy, starts, ends), [copy, starts, ends]


def kept_bytes(batch: pa.RecordBatch, names: list[str], length: int) -> Iterator[tuple[bytes, list[bytes], int]]:
    """Per row the whole text, what is kept of it in pieces, and the number of removed runs."""
    for text, copy, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", *names)), strict=True):
        data = (text or "").encode()
        if copy and len(data) >= length:
            yield data, [], 1
            continue
        pieces, last, runs = [], 0, 0
        for s, e in zip(np.frombuffer(a or b"", "<i8").tolist(), np.frombuffer(b or b"", "<i8").tolist(), strict=True):
            pieces.append(data[last:s])
            last, runs = e, runs + 1
        yield data, [*pieces, data[last:]], runs


def report(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(len(data), len(data) - sum(map(len, kept)), runs, sha256(b"".join(kept)).hexdigest()) for data, kept, runs in kept_bytes(batch, names, length)]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.record_batch([batch.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own, names = with_ranges(docs.select(F.col("doc_id").cast("long"), "text"), length, anchor)
    return common.map_batches(own, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The rows, with all their columns, without the bytes that earlier documents have; rows of which nothing
    is left go.  ``n_chars``, if there is one, follows the text."""
    own, added = with_ranges(docs, length, anchor)
    names = docs.columns

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, stay = [], []
        for text, (_, kept, runs) in zip(batch.column("text").to_pylist(), kept_bytes(batch, added, length), strict=True):
            new = b"".join(p.decode(errors="ignore").encode() for p in kept).decode() if runs else text
            texts.append(new)
            stay.append(not runs or bool(new.strip()))
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(texts, batch.column("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
        return pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(stay, pa.bool_()))

    return common.map_batches(own, each, docs.schema)
