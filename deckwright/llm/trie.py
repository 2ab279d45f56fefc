"""The prefix trie of conversations: which turns they share, and what sharing them saves.

A conversation is a path of turns, each turn known by the SHA-256 digest of its role and text; a node is a distinct
beginning of paths.  Texts are read once, where they become digests and numbers of words.

Equal paths are folded first, so a conversation with very many copies is one row; distinct paths are dealt out by
range and sorted, and every stretch of at most ``common.SLICE_BYTES`` is one shard.  In a shard the digests become
dense numbers in a matrix of one row a path, padded with -1; ``lexsort`` orders the rows, a mask of where a row differs
from the one before, accumulated by OR along the columns, marks where nodes start, and ``reduceat`` over these starts
aggregates every depth, the deepest first.  Matrices are cut into blocks of ``COLUMNS`` columns, of which only rows that
reach them take part, so a path of very many turns widens no other row.

Nodes on a shard's first and last path may go on in the shards beside it.  They are not counted there but handed on: two
paths a shard, with what hangs below each of their nodes summed up, are the rows of another, much smaller round of the
same work, until one shard can hold all that is left.  What is below such nodes learns its parent's conversation by a join.

A node's conversations that end in it are hashed in order of id.  Ids are sorted and packed by blocks of ``ID_BLOCK``
ids and path, and a stream of blocks feeds the hash, so memory is bounded; a hash over ids in order has no parallel form,
so one task reads the packed blocks of a path.

Defined cases: a null role or text is empty; turns go by number, null first, turns of one number by digest; rows without
a conversation's id are left out; repeated rows are repeated turns; conversations without turns end in the root; an empty
table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = "[^\\x20\\x09-\\x0D]+"
#: Bytes of a digest, columns of a matrix, and ids packed together (a power of two).
DIGEST, COLUMNS, ID_BLOCK = 32, 32, 4_096
#: Bytes of paths, and fewest paths, of a shard; bytes or paths that the last one holds.
SHARD_BYTES, SHARD_PATHS, LAST_BYTES, LAST_PATHS = 4_000_000, 16, 32_000_000, 64
NOTHING = hashlib.sha256(b"").hexdigest()
FAR = np.iinfo(np.int64).max

NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: One path: for each depth from 0 its words, and what is known of the node there, of the part of its subtree that no deeper
#: node of the same path has: conversations, leaves, saved tokens, children; the least conversation of the whole subtree.
PATH = "path binary, words array<long>, members array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
NUMBERS = ("words", "members", "least", "kids", "leaves", "saved")
NODE_NAMES, PATH_NAMES = ([x.split()[0] for x in kinds.split(", ")] for kinds in (NODE, PATH))
_KINDS = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
ARROW = pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in f"{NODE}, {PATH}".split(", "))])


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as structs of digest and number of words."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(blank(role)).cast("string"), F.lit(":"), blank(role), blank(text)).cast("binary"), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(blank(text), F.lit(WORDS)).cast("long").alias("words"))
    # sort_array puts nulls first, and orders what shares a number by digest
    ordered = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def with_shared_heads(convs: DataFrame, family: int, heads: int) -> DataFrame:
    """Every conversation c rebuilt: the first h turns of conversation c - c % family, then its own after its first h;
    h is crc32 of c in decimals, modulo ``heads``."""
    rows = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    first = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("first"))
    head = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.join(first, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def paths(convs: DataFrame) -> DataFrame:
    """Distinct paths, as rows of PATH."""
    # digests have one length, so their concatenation is the path
    hexed = F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")
    rows = convs.select("conv_id", F.unhex(hexed).alias("path"), F.concat(F.array(F.lit(0).cast("long")), F.transform("turns", lambda x: x["words"])).alias("words"))
    rows = common.cut(rows.withColumn("name", F.unhex(F.sha2("path", 256))))
    blocks = rows.groupBy("name", F.shiftright("conv_id", ID_BLOCK.bit_length() - 1).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.select("name", "block", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    ends = blocks.repartition("name").sortWithinPartitions("name", "block").mapInArrow(hashed, "name binary, n long, least long, ends string")
    # one row a path, whatever the number of its copies
    one = rows.groupBy("name").agg(F.min(F.struct("path", "words")).alias("one")).select("name", "one.path", "one.words")
    zero = F.lit(0).cast("long")
    at_end = lambda value, other: F.concat(F.transform(F.slice("words", F.lit(1), F.size("words") - 1), lambda _: other), F.array(value))
    return one.join(ends, "name").select(
        "path", "words", at_end(F.col("n"), zero).alias("members"), at_end(F.col("least"), F.lit(FAR)).alias("least"), *(F.transform("words", lambda _: zero).alias(c) for c in ("kids", "leaves", "saved")),
        at_end(F.col("ends"), F.lit(None).cast("string")).alias("ends"),
    )


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a name from blocks of ids in order."""
    name, n, least, sha = None, 0, 0, hashlib.sha256()
    schema = pa.schema([("name", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])
    for batch in common.slices(batches):
        done = []
        for own, count, first, text in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "least", "text")), strict=True):
            if own != name:
                if name is not None:
                    done.append((name, n, least, sha.hexdigest()))
                name, n, least, sha = own, 0, first, hashlib.sha256()
            sha.update((("," if n else "") + text).encode())
            n += count
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, n, least, sha.hexdigest()), schema, strict=True)], schema=schema)


def ordered(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The paths' order, and for each block of columns: the places in that order that reach it, their padded matrix, and
    the mask of where nodes start.  Path i has the turns of ``ids`` from start[i] on."""
    order, run = np.argsort(length > 0, kind="stable"), np.zeros(len(length), np.int64)  # the empty path is first
    blocks = []
    widest = int(length.max(initial=0))
    for left in range(0, widest, COLUMNS):
        place = np.flatnonzero(length[order] > left)
        rows = order[place]
        at = left + np.arange(min(COLUMNS, widest - left))
        inside = at < length[rows][:, None]
        matrix = np.where(inside, ids[np.where(inside, start[rows][:, None] + at, 0)], -1)
        # what ended before stands first in its run, so that the rest keep the places behind it
        by = np.lexsort((length[rows] > left + COLUMNS, *matrix.T[::-1], run[place]))
        order[place], matrix, before = rows[by], matrix[by], run[place]
        change = np.ones(matrix.shape, bool)
        change[1:] = matrix[1:] != matrix[:-1]
        change[1:, 0] |= before[1:] != before[:-1]
        mask = np.logical_or.accumulate(change, 1)
        run[place] = place[np.maximum.accumulate(np.where(mask[:, -1], np.arange(len(place)), 0))]
        blocks.append((place, matrix, mask))
    return order, blocks


class Shard:
    """The nodes of some distinct paths.  The cells of path i, one for each depth from 0, are those from offset[i] on."""

    def __init__(self, path: list[bytes], cells: dict[str, np.ndarray], ends: list[str | None], offset: np.ndarray, last: bool) -> None:
        self.path, self.cells, self.ends, self.offset, self.last = path, cells, ends, offset, last
        self.length = np.diff(offset) - 1
        flat = np.frombuffer(b"".join(path), np.dtype((np.void, DIGEST)))
        ids = np.unique(flat, return_inverse=True)[1].reshape(-1) if len(flat) else np.zeros(1, np.int64)
        self.order, self.blocks = ordered(ids, offset[:-1] - np.arange(len(path)), self.length)
        first, final = path[self.order[0]], path[self.order[-1]]
        #: Depths of the first and the last path, and how far they are one.
        self.deep = (int(self.length[self.order[0]]), int(self.length[self.order[-1]]))
        self.one = next((i for i in range(min(self.deep)) if first[DIGEST * i : DIGEST * (i + 1)] != final[DIGEST * i : DIGEST * (i + 1)]), min(self.deep))
        self.levels = self.aggregated()

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the paths that reach this depth, and which of them start a node."""
        if depth == 0:
            return np.arange(len(self.order)), np.arange(len(self.order)) == 0
        place, matrix, mask = self.blocks[(depth - 1) // COLUMNS]
        column = (depth - 1) % COLUMNS
        held = matrix[:, column] >= 0
        return place[held], mask[held, column]

    def aggregated(self) -> list[dict[str, np.ndarray]]:
        """The nodes of each depth.  From the deepest up, each path sums up its cells so far, and a node is a run of
        paths; a whole node adds itself to the cells of its first path, for those above it."""
        n = len(self.order)
        members, leaves, saved, least = (np.full(n, x) for x in (0, 0, 0, FAR))
        end_cell = np.where(np.array([x is not None for x in self.ends], bool), np.arange(len(self.ends)), -1)
        levels: list[dict[str, np.ndarray]] = []
        for depth in range(int(self.length.max(initial=0)), -1, -1):
            place, starts = self.level(depth)
            cell = self.offset[self.order[place]] + depth
            members[place] += self.cells["members"][cell]
            leaves[place] += self.cells["leaves"][cell]
            saved[place] += self.cells["saved"][cell]
            least[place] = np.minimum(least[place], self.cells["least"][cell])
            first = np.flatnonzero(starts)
            border = np.zeros(len(first), bool)
            if not self.last:
                border[0], border[-1] = border[0] or depth <= self.deep[0], border[-1] or depth <= self.deep[1]
                if len(first) == 1:
                    border[0] = depth <= max(self.deep)
            kids = np.add.reduceat(self.cells["kids"][cell], first)
            if levels:
                below = levels[-1]
                below["parent"] = (np.cumsum(starts) - 1)[np.searchsorted(place, below["place"])]
                kids += np.bincount(below["parent"][~below["border"]], minlength=len(first))
            at, count = place[first], np.add.reduceat(members[place], first)
            leaves[at] += (kids == 0) & ~border
            saved[at] += np.where(border, 0, (count - 1) * self.cells["words"][cell[first]])
            levels.append({
                "place": at, "border": border, "conv_id": np.minimum.reduceat(least[place], first), "n_convs": count, "n_children": kids,
                "n_leaves": np.add.reduceat(leaves[place], first), "saved_tokens": np.add.reduceat(saved[place], first), "end": np.maximum.reduceat(end_cell[cell], first),
            })
        return levels[::-1]

    def key(self, place: int, depth: int) -> bytes:
        return hashlib.sha256(self.path[self.order[place]][: DIGEST * depth]).digest()

    def nodes(self, keyed: bool) -> list[pa.Array]:
        """Columns of NODE, of the nodes that are whole here; ``keyed``: with keys of their own."""
        out: dict[str, list[pa.Array]] = {name: [] for name in NODE_NAMES}
        for depth, x in enumerate(self.levels):
            whole = np.flatnonzero(~x["border"])
            n = len(whole)
            keys, parents, convs = [None] * n, [None] * n, pa.nulls(n, pa.int64())
            if depth and n:
                up = self.levels[depth - 1]
                parent = x["parent"][whole]
                open_ = up["border"][parent]
                convs = pa.array(up["conv_id"][parent], mask=open_)
                names = {p: self.key(up["place"][p], depth - 1) for p in np.unique(parent[open_]).tolist()}
                parents = [names.get(p) for p in parent.tolist()]
            if keyed:
                keys = [self.key(p, depth) for p in x["place"][whole].tolist()]
            ends = [NOTHING if i < 0 else self.ends[i] for i in x["end"][whole].tolist()]
            columns = [pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), pa.array(x["conv_id"][whole]), pa.array(np.full(n, depth)), convs]
            columns += [pa.array(x[c][whole]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")] + [pa.array(ends, pa.string())]
            for name, column in zip(NODE_NAMES, columns, strict=True):
                out[name].append(column)
        return [pa.concat_arrays(x) for x in out.values()]

    def handed_on(self) -> list[dict]:
        """The first and the last path as rows of PATH.  What both have is told with the first alone."""
        if self.last:
            return []
        out = []
        for side in range(min(2, len(self.order))):
            row = self.order[-side]
            cells: dict[str, list] = {c: [] for c in (*NUMBERS, "ends")}
            for depth in range(self.deep[side] + 1):
                x, i = self.levels[depth], -side
                told = side == 1 and depth <= self.one
                cells["words"].append(int(self.cells["words"][self.offset[row] + depth]))
                handed = [] if told else self.handed_below(depth, side)
                for c, name in (("members", "n_convs"), ("leaves", "n_leaves"), ("saved", "saved_tokens")):
                    cells[c].append(0 if told else int(x[name][i]) - sum(int(self.levels[depth + 1][name][j]) for j in handed))
                cells["kids"].append(0 if told else int(x["n_children"][i]))
                cells["least"].append(FAR if told else int(x["conv_id"][i]))
                cells["ends"].append(None if told or x["end"][i] < 0 else self.ends[x["end"][i]])
            out.append({"path": self.path[row], **cells})
        return out

    def handed_below(self, depth: int, side: int) -> set[int]:
        """The children of a path's node that are handed on as well."""
        count = len(self.levels[depth + 1]["place"]) if depth + 1 < len(self.levels) else 0
        both = depth <= self.one
        out = {0} if depth < self.deep[0] and (side == 0 or both) else set()
        return out | ({count - 1} if depth < self.deep[1] and (side == 1 or both) else set())


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches of about SHARD_BYTES of paths, but SHARD_PATHS at least, as far as a task has them."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for part in common.slices(iter([batch]), "path", SHARD_BYTES):
            held.append(part)
            size += part.column("path").nbytes
            rows += part.num_rows
            if size >= SHARD_BYTES and rows >= SHARD_PATHS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, rows = [], 0, 0
    if rows:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shard_of(batch: pa.RecordBatch, last: bool) -> Shard:
    lists = batch.column("words")
    offset = lists.offsets.to_numpy().astype(np.int64)
    cells = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in NUMBERS}
    return Shard(batch.column("path").to_pylist(), cells, batch.column("ends").flatten().to_pylist(), offset - offset[0], last)


def round_of(rows: DataFrame, last: bool, keyed: bool) -> DataFrame:
    """Whole nodes and paths handed on, side by side in one table: either half of a row is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.Table.from_batches(held).combine_chunks().to_batches() if last and (held := [b for b in batches if b.num_rows]) else stretches(batches)
        for batch in parts:
            shard = shard_of(batch, last)
            found, on = shard.nodes(keyed), shard.handed_on()
            empty = [pa.nulls(len(found[0]), ARROW.field(c).type) for c in PATH_NAMES]
            yield pa.RecordBatch.from_arrays([*found, *empty], schema=ARROW)
            if on:
                handed = [pa.array([x[c] for x in on], ARROW.field(c).type) for c in PATH_NAMES]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(on), ARROW.field(c).type) for c in NODE_NAMES), *handed], schema=ARROW)

    return rows.mapInArrow(run, f"{NODE}, {PATH}")


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of conversations in the shape that :func:`turns` gives: ``conv_id`` (the least that begins so), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    rows = common.cut(paths(convs).repartitionByRange("path").sortWithinPartitions("path"))
    rounds: list[DataFrame] = []
    last = False
    while not last:
        count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
        last = size <= LAST_BYTES and bool(rounds) or count <= LAST_PATHS
        if rounds or last:
            # a later round has shards full of paths, so each is a fraction of the one before
            parts = 1 if last else max(1, min(-(-size // SHARD_BYTES), count // SHARD_PATHS))
            rows = rows.repartitionByRange(parts, "path").sortWithinPartitions("path")
        done = common.cut(round_of(rows, last, keyed=bool(rounds)))
        rounds.append(done.where(F.col("depth").isNotNull()).select(NODE_NAMES))
        rows = done.where(F.col("depth").isNull()).select(PATH_NAMES)
    out = rounds[0]
    if len(rounds) > 1:
        later = rounds[1]
        for more in rounds[2:]:
            later = later.unionByName(more)
        above = common.cut(later.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
        every = out.unionByName(later)
        open_ = common.join_few(every.where(F.col("parent_key").isNotNull()), above, ["parent_key"], "left", "conv_id")
        out = every.where(F.col("parent_key").isNull()).unionByName(open_.withColumn("parent_conv_id", F.col("above")).select(NODE_NAMES))
    return out.drop("key", "parent_key")
