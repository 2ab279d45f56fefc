"""External induced sorting of suffixes, with common-prefix values.

Suffixes are L (greater than the next one) or S (smaller).  The leftmost S suffixes (LMS) are sorted by giving
each LMS substring a number in order and sorting the sequence of these numbers in the same way, down to a
sequence that fits in memory.  A scan in order then induces the L suffixes from the LMS ones, and a scan in
reverse order the S suffixes from the L ones.

What a scan has yet to visit stands in a priority queue by first symbol.  Its tuples (position, common prefix
with the tuple before) are pushed and popped as arrays, and arrays go to disk when they outgrow the memory
allowed.  The common prefix of two neighbours is one more than the least value that the scan passed between
the two suffixes which induced them, so the values come with the order, without comparing texts again.

Only the first ``depth`` symbols count: suffixes equal in these may come in any order, and values stop there.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

from . import textscan

#: Bytes of tuples that a queue keeps in memory before they go to disk, and symbols of a reduced sequence that
#: is sorted without inducing (a few arrays of 8 bytes each; beyond, the recursion goes on).
QUEUE_BYTES, MEMORY_SYMBOLS = 4_000_000, 4_000_000
#: Tuples that a scan looks at in one step: many pushes are a few tuples each, so what waits for a symbol is visited together.
STEP = 65536
#: The power of two that fits a range of this length.
LEVEL = np.log2(np.maximum(np.arange(STEP + 1), 1)).astype(np.int64)

Consumer = Callable[[np.ndarray, np.ndarray], None]


class Queue:
    """Arrays of (position, common prefix) by symbol, first in first out, on disk beyond ``most`` bytes."""

    def __init__(self, most: int | None = None) -> None:
        self.most, self.held = QUEUE_BYTES if most is None else most, 0
        self.blocks: dict[int, list] = defaultdict(list)
        self.file = None
        self.spilled = 0

    def push(self, symbol: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.blocks[symbol].append((positions, common))
        self.held += positions.nbytes + common.nbytes
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for blocks in self.blocks.values():
            for i, block in enumerate(blocks):
                if len(block) == 2:
                    at = self.file.tell()
                    self.file.write(block[0].astype("<i8").tobytes() + block[1].tobytes())
                    blocks[i] = (at, len(block[0]), 0)
        self.held, self.spilled = 0, self.spilled + 1

    def read(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        self.file.seek(block[0])
        raw = self.file.read(9 * block[1])
        return np.frombuffer(raw, "<i8", block[1]), np.frombuffer(raw, np.uint8, block[1], 8 * block[1])

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of this symbol, small ones joined, those that are pushed meanwhile among them."""
        size = lambda block: len(block[0]) if len(block) == 2 else block[1]
        while waiting := self.blocks.get(symbol):
            n, total = 1, size(waiting[0])
            while n < len(waiting) and total + size(waiting[n]) <= STEP:
                total += size(waiting[n])
                n += 1
            taken = [self.read(block) for block in waiting[:n]]
            del waiting[:n]
            yield taken[0] if n == 1 else (np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]))
        self.blocks.pop(symbol, None)

    def close(self) -> None:
        if self.file:
            self.file.close()


def is_small(sequence: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last one is."""
    # a run of equal symbols has the type of its last
    last = np.flatnonzero(sequence[:-1] != sequence[1:])
    less = np.append(sequence[last] < sequence[last + 1], True)
    return np.repeat(less, np.diff(last, prepend=-1, append=len(sequence) - 1))


class Minima:
    """The least value of any range of an array of at most ``STEP`` bytes."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.n, self.table = n, np.empty((int(LEVEL[n]) + 1, n), np.uint8)
        self.table[0] = values
        for k in range(1, len(self.table)):
            step = 1 << (k - 1)
            np.minimum(self.table[k - 1, :-step], self.table[k - 1, step:], out=self.table[k, :-step])

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """``last`` is within the range."""
        level = LEVEL[last - first + 1]
        row, flat = level * self.n, self.table.reshape(-1)
        return np.minimum(flat[row + first], flat[row + last + 1 - (1 << level)])


class Scan:
    """Pushes what scanned tuples induce, with common prefixes."""

    def __init__(self, sequence: np.ndarray, queue: Queue, symbols: int, depth: int) -> None:
        self.sequence, self.queue, self.depth = sequence, queue, depth
        self.since = np.zeros(symbols, np.uint8)  # least value since the last push for each symbol

    def visit(self, positions: np.ndarray, common: np.ndarray, induces: np.ndarray) -> None:
        """``common``: with the tuple visited before; ``induces``: whose predecessors are to be pushed."""
        if not len(positions):
            return
        if len(positions) > STEP:
            for a in range(0, len(positions), STEP):
                self.visit(positions[a : a + STEP], common[a : a + STEP], induces[a : a + STEP])
            return
        at = np.flatnonzero(induces)
        if len(at):
            before = positions[at] - 1
            target = self.sequence[before]
            order = np.argsort(target, kind="stable")
            at, before, target = at[order], before[order], target[order]
            first = np.concatenate([[True], target[1:] != target[:-1]])
            value = np.empty(len(at), np.uint8)
            lead = np.minimum.accumulate(common)
            value[first] = np.minimum(self.since[target[first]], lead[at[first]])
            if not first.all():
                later = np.flatnonzero(~first)
                value[later] = Minima(common).between(at[later - 1] + 1, at[later])
            value = np.minimum(value.astype(np.int64) + 1, self.depth).astype(np.uint8)
            starts = np.flatnonzero(first)
            ends = np.concatenate([starts[1:], [len(at)]])
            tail = np.concatenate([np.minimum.accumulate(common[::-1])[::-1], [255]]).astype(np.uint8)
            np.minimum(self.since, lead[-1], out=self.since)
            self.since[target[starts]] = tail[at[ends - 1] + 1]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                self.queue.push(int(target[s]), before[s:e], value[s:e])
        else:
            np.minimum(self.since, common.min(), out=self.since)


def common_prefix(sequence: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Of the suffixes at a and b, compared symbol by symbol up to depth."""
    n, out, open_ = len(sequence), np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(depth):
        x, y = a[open_] + k, b[open_] + k
        inside = (x < n) & (y < n)
        open_ = open_[inside]
        open_ = open_[sequence[x[inside]] == sequence[y[inside]]]
        if not len(open_):
            break
        out[open_] = k + 1
    return out.astype(np.uint8)


def in_memory(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by prefix doubling."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(sequence)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        step *= 2
        if new[-1] == n - 1 or step >= min(n, depth):
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new


def names(sequence: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The number in order of each LMS substring (up to the next LMS symbol)."""
    typed = sequence.astype(np.uint32) << np.uint32(1) | small
    ends = np.concatenate([lms[1:] + 1, lms[-1:] + 1])
    prefix = np.zeros(len(typed) + 1, np.uint64)
    for a in range(0, len(typed), textscan.STEP_BYTES):
        b = min(a + textscan.STEP_BYTES, len(typed))
        np.cumsum(textscan.mix(typed[a:b].astype(np.uint64) + np.uint64(1)) * (textscan.power_table(textscan._P, textscan.STEP_BYTES)[: b - a] * np.uint64(pow(textscan._P, a, 1 << 64))), out=prefix[a + 1 : b + 1])
        prefix[a + 1 : b + 1] += prefix[a]
    code = textscan.mix((prefix[ends] - prefix[lms]) * textscan.powers_at(textscan._P_INV, lms) + (ends - lms).astype(np.uint64))
    del prefix
    _, first, number = np.unique(code, return_index=True, return_inverse=True)
    wide = typed.astype(">u4")
    content = [wide[a:b].tobytes() for a, b in zip(lms[first].tolist(), ends[first].tolist(), strict=True)]
    rank = np.empty(len(first), np.int64)
    rank[sorted(range(len(first)), key=content.__getitem__)] = np.arange(len(first))
    return rank[number]


def sort(sequence: np.ndarray, depth: int, consume: Consumer, memory_symbols: int | None = None, queue_bytes: int | None = None) -> None:
    """Calls ``consume`` with (positions in order, common prefix with the one before) for each first symbol,
    from the greatest down.  The sequence ends with 0, which is nowhere else in it."""
    small = is_small(sequence)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = lms
    if len(lms) > 1:
        number = names(sequence, small, lms)
        if number.max() + 1 == len(lms):
            ordered = lms[np.argsort(number)]
        elif len(lms) <= (MEMORY_SYMBOLS if memory_symbols is None else memory_symbols):
            ordered = lms[in_memory(number, depth + 2)]
        else:
            got: list[np.ndarray] = []
            sort(number, depth + 2, lambda positions, _: got.append(positions), memory_symbols, queue_bytes)
            ordered = lms[np.concatenate(got[::-1])]
    common = np.zeros(len(ordered), np.uint8)
    common[1:] = common_prefix(sequence, ordered[:-1], ordered[1:], depth)
    induce(sequence, small, ordered, common, depth, consume, queue_bytes)


def induce(sequence: np.ndarray, small: np.ndarray, ordered: np.ndarray, common: np.ndarray, depth: int, consume: Consumer, queue_bytes: int | None) -> None:
    symbols = int(sequence.max()) + 1
    present = np.unique(sequence).tolist()
    heads = sequence[ordered]
    bounds = dict(zip(present, zip(np.searchsorted(heads, present, "left").tolist(), np.searchsorted(heads, present, "right").tolist(), strict=True), strict=True))
    waiting, large = Queue(queue_bytes), Queue(queue_bytes)
    scan = Scan(sequence, waiting, symbols, depth)

    def link(a: np.ndarray, b: np.ndarray) -> np.uint8:
        return common_prefix(sequence, a[-1:], b[:1], depth)[0]

    for symbol in present:  # L suffixes, in order
        last = None
        for positions, value in waiting.pop(symbol):
            value = value.copy()
            if last is None:
                value[0] = 0
            large.push(symbol, positions, value)
            last = positions
            scan.visit(positions, value, (positions > 0) & ~small[positions - 1])
        a, b = bounds[symbol]
        if a < b:
            value = common[a:b].copy()
            value[0] = 0 if last is None else link(last, ordered[a:b])
            scan.visit(ordered[a:b], value, ordered[a:b] > 0)
    scan = Scan(sequence, waiting, symbols, depth)
    for symbol in reversed(present):  # S suffixes, in reverse order
        found, values = [], []
        for positions, value in waiting.pop(symbol):
            value = value.copy()
            if not found:
                value[0] = 0
            found.append(positions)
            values.append(value)
            scan.visit(positions, value, (positions > 0) & small[positions - 1])
        blocks = list(large.pop(symbol))
        own = np.concatenate([b[0] for b in blocks]) if blocks else np.empty(0, np.int64)
        own_common = np.concatenate([b[1] for b in blocks]) if blocks else np.empty(0, np.uint8)
        if symbol == 0:  # the end mark, which nothing induces
            found, values = [np.array([len(sequence) - 1])], [np.zeros(1, np.uint8)]
        mine = np.concatenate(found) if found else np.empty(0, np.int64)
        mine_common = np.concatenate(values) if values else np.empty(0, np.uint8)
        joint = link(own, mine[::-1]) if len(own) and len(mine) else np.uint8(0)
        if len(own):
            back = np.concatenate([[joint], own_common[:0:-1]]).astype(np.uint8)
            scan.visit(own[::-1], back, (own[::-1] > 0) & small[own[::-1] - 1])
        # in order: the L suffixes, then the S suffixes turned round
        turned = np.concatenate([[joint], mine_common[:0:-1]]).astype(np.uint8) if len(mine) else mine_common
        consume(np.concatenate([own, mine[::-1]]), np.concatenate([own_common, turned]))
    waiting.close()
    large.close()
