"""Texts as sequences of atoms, and the token ids of atoms, for tokenizers whose words never cross them.

An atom is a run between white space, cut where letters meet signs: there one word ends and the next begins.
Atoms are found and hashed in the texts' bytes, many texts at once, and only atoms that a worker doesn't
remember go through a tokenizer.  What it remembers is bounded in bytes, in two generations: what is asked for
again outlives the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from . import textscan

#: Bytes of atoms and ids, with what a dictionary's entry takes, that a generation holds; bytes of text in a step.
GENERATION_BYTES, ENTRY_BYTES, STEP_BYTES = 24_000_000, 160, 1_000_000
SPACE, LETTER, SIGN, OTHER = range(4)
#: Kinds of bytes; digits, apostrophes, bars and what is no ASCII make no cut.
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(9, 14), 32]] = SPACE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[b for b in range(33, 127) if KIND[b] == OTHER and not chr(b).isdigit() and chr(b) not in "'|"]] = SIGN


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; characters from U+00C0 to U+027F are letters, but for the times and division signs
    and the dotted capital I, whose small form ends with a mark, which isn't one."""
    out = KIND[data]
    lead = (data >= 0xC3) & (data <= 0xC9)
    if lead.any():
        at = np.flatnonzero(lead[:-1])
        follow = data[at + 1]
        at = at[(follow & 0xC0 == 0x80) & ~((data[at] == 0xC3) & ((follow == 0x97) | (follow == 0xB7))) & ~((data[at] == 0xC4) & (follow == 0xB0))]
        out[at] = out[at + 1] = LETTER
    return out


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of atoms, and the n + 1 offsets of the texts in them."""
    kind = kinds(data)
    cut = np.ones(len(data) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = (a == SPACE) | (b == SPACE) | (a + b == LETTER + SIGN) & (a != OTHER) & (b != OTHER)
    cut[offsets] = True
    filled = kind != SPACE
    starts, ends = np.flatnonzero(cut[:-1] & filled), np.flatnonzero(cut[1:] & filled) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case, but for atoms in which that might change ids: those with characters from
    U+0300 on (some compose with capitals only, or with small letters only) and those that may hold a special token."""
    low = textscan.LOWER[data]
    flags = (data >= 0xCC) | (data == ord("|"))
    if flags.any():
        total = np.concatenate([[0], np.cumsum(flags)])
        kept = np.flatnonzero(total[ends] > total[starts])
        edge = np.bincount(starts[kept], minlength=len(data) + 1) - np.bincount(ends[kept], minlength=len(data) + 1)
        inside = np.cumsum(edge)[:-1] > 0
        low[inside] = data[inside]
    return low


class Memory:
    """Ids by an atom's bytes, in two generations of bounded size."""

    def __init__(self, most: int = GENERATION_BYTES) -> None:
        self.most, self.size = most, 0
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def recall(self, keys: list[bytes], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """A value for each of different atoms; ``learn`` gives those that neither generation has."""
        out = list(map(self.new.get, keys))
        missing = [i for i, x in enumerate(out) if x is None]
        asked = list(map(keys.__getitem__, missing))
        values = list(map(self.old.get, asked))
        unknown = [k for k, x in enumerate(values) if x is None]
        for k, value in zip(unknown, learn([asked[k].decode() for k in unknown]) if unknown else [], strict=True):
            values[k] = value
        for i, value in zip(missing, values, strict=True):
            out[i] = value
        self.new.update(zip(asked, values, strict=True))
        self.size += ENTRY_BYTES * len(asked) + sum(map(len, asked)) + sum(map(len, values))
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0
        return out


class Texts:
    """A step's texts: their different atoms' values, the number of the value of each atom in order, and the
    texts' offsets in these."""

    def __init__(self, values: list[bytes], numbers: np.ndarray, at: np.ndarray) -> None:
        self.values, self.numbers, self.at = values, numbers, at

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other (32 bits), and the n + 1 offsets of the texts in them."""
        sizes = np.fromiter(map(len, self.values), np.int64, len(self.values)) // 4
        flat = np.frombuffer(b"".join(self.values), "<u4")
        begin = np.cumsum(sizes) - sizes
        count = sizes[self.numbers]
        total = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(begin[self.numbers] - total[:-1], count) + np.arange(total[-1])], total[self.at]


def encoded(column: pa.Array, memory: Memory, learn: Callable[[list[str]], list[bytes]]) -> Iterator[Texts]:
    """Steps of the texts; ``learn`` gives the ids of atoms."""
    data, offsets = textscan.text_bytes(column)
    for a, b in textscan.steps(offsets, STEP_BYTES):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, bounds = spans(own, at)
        low = lowered(own, starts, ends)
        numbers, different = pd.factorize(textscan.word_codes(low, starts, ends))
        first = np.empty(len(different), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers) - 1, -1, -1)
        raw = low.tobytes()
        yield Texts(memory.recall([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], learn), numbers, bounds)
