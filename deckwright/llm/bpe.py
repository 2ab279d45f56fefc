"""Byte-pair encoding and decoding by a contiguous rank array, for many short words at once.

A word is a row of a small matrix: its parts, and beside them the rank of each adjacent pair.  Every step
takes the least rank of each row (the leftmost, on ties), joins those two parts, closes the gap, and looks up
the two ranks beside it.  Rows without a known pair are done.  A text is a sequence of words, and a word's
ids depend on nothing else, so each distinct one is encoded once per worker as long as it is remembered
(:mod:`.atoms`).  The array is for short words; a word of over ``LONG_WORD`` bytes goes by a heap instead.

The vocabulary file is one of the ``tokenizers`` library's with BPE, byte-level symbols, a word-end suffix
and the normaliser NFC, white space, lower case; the results are that library's.  Strings of special tokens
within a text are their ids.

Defined cases: a null or empty text has no ids and decodes to the empty text; repeated rows encode alike; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import atoms, common

#: Longer words are encoded a few at a time, so that the matrix stays small.
MATRIX_CELLS = 2_000_000
#: Words of more bytes leave the matrix: a heap of ranks and linked parts take them in n log n steps.
LONG_WORD = 256
_NONE = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is visible
    in Latin-1, else the next one from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in merges], np.int32)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memory = atoms.Memory()

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], _NONE)

    def encode_matrix(self, data: list[bytes]) -> list[bytes]:
        """The ids of words (as bytes of a text in UTF-8), each as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in data])
        width = int(lengths.max())
        parts = np.zeros((len(data), width + 1), np.int32)
        flat = np.frombuffer(b"".join(data), np.uint8)
        row = np.repeat(np.arange(len(data)), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        parts[row, column] = self.inner[flat]
        parts[np.arange(len(data)), lengths - 1] = self.last[[w[-1] for w in data]]
        ranks = np.full((len(data), width + 1), _NONE, np.int32)
        pair = column < lengths[row] - 1
        ranks[row[pair], column[pair]] = self.rank_of(parts[row[pair], column[pair]], parts[row[pair], column[pair] + 1])
        active, p, r, n = np.arange(len(data)), parts, ranks, lengths.copy()
        out_parts, out_n = parts, lengths.copy()
        columns = np.arange(width + 1)
        while len(active):
            at = r.argmin(1)
            least = r[np.arange(len(r)), at]
            going = least < _NONE
            if not going.all():
                done = ~going
                out_parts[active[done]], out_n[active[done]] = p[done], n[done]
                active, p, r, n, at, least = active[going], p[going], r[going], n[going], at[going], least[going]
                if not len(active):
                    break
            rows = np.arange(len(active))
            p[rows, at] = self.joined[least]
            shifted = np.minimum(columns + (columns > at[:, None]), width)
            p = np.take_along_axis(p, shifted, 1)
            shifted = np.minimum(columns + (columns >= at[:, None]), width)
            r = np.take_along_axis(r, shifted, 1)
            n -= 1
            right = at < n - 1
            r[rows, at] = _NONE
            r[rows[right], at[right]] = self.rank_of(p[rows[right], at[right]], p[rows[right], at[right] + 1])
            left = at > 0
            r[rows[left], at[left] - 1] = self.rank_of(p[rows[left], at[left] - 1], p[rows[left], at[left]])
        out_parts = out_parts.astype("<u4")
        return [out_parts[i, :k].tobytes() for i, k in enumerate(out_n.tolist())]

    def encode_long(self, word: bytes) -> bytes:
        """The ids of one long word: the least rank (the leftmost, on ties) comes from a heap, and parts are linked
        to their neighbours."""
        parts = self.inner[np.frombuffer(word, np.uint8)]
        parts[-1] = self.last[word[-1]]
        ranks = self.rank_of(parts[:-1], parts[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks < _NONE)]
        heapq.heapify(heap)
        own, joined = parts.tolist(), self.joined
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        current = ranks.tolist() + [_NONE]  # of the pair that begins here
        while heap:
            rank, i = heapq.heappop(heap)
            if current[i] != rank:
                continue
            gone = after[i]
            own[i], own[gone], current[gone] = int(joined[rank]), -1, -1
            after[i] = after[gone]
            if after[i] < len(own):
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    current[left] = self.rank_one(own[left], own[right]) if right < len(own) else -1
                    if current[left] >= 0:
                        heapq.heappush(heap, (current[left], left))
        return np.array([x for x in own if x >= 0], "<u4").tobytes()

    def rank_one(self, left: int, right: int) -> int:
        """The rank of a pair, or -1."""
        key = left << 20 | right
        at = int(np.searchsorted(self.pairs, key))
        return int(self.ranks[at]) if at < len(self.pairs) and self.pairs[at] == key else -1

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Words of similar length share a matrix."""
        data = [w.encode() for w in words]
        out: list[bytes] = [b""] * len(data)
        order = sorted(range(len(data)), key=lambda i: len(data[i]))
        while order and len(data[order[-1]]) > LONG_WORD:
            i = order.pop()
            out[i] = self.encode_long(data[i])
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * len(data[order[b]]) <= MATRIX_CELLS and len(data[order[b]]) <= len(data[order[a]]) + 4:
                b += 1
            for i, ids in zip(order[a:b], self.encode_matrix([data[i] for i in order[a:b]]), strict=True):
                out[i] = ids
            a = b
        return out

    def pieces(self, atom: str) -> list[str | int]:
        """The words of an atom, special tokens as ids."""
        out: list[str | int] = []
        for part in self.specials.split(atom) if self.specials and "<|" in atom else [atom]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                out += self.words(part.lower() if part.isascii() else part)
        return out

    def learn(self, parts: list[str]) -> list[bytes]:
        """The ids of atoms, through their different words."""
        split = list(map(self.pieces, parts))
        words = list({w for own in split for w in own if isinstance(w, str)})
        known = dict(zip(words, self.encode_words(words), strict=True))
        return [b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in own]) for own in split]

    def encoded(self, texts: pa.Array) -> Iterator[atoms.Texts]:
        return atoms.encoded(texts, self.memory, self.learn)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        out = []
        for step in self.encoded(pa.array(texts, pa.large_string())):
            ids, at = step.ids()
            out += [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return out

    @property
    def table(self) -> list[bytes]:
        if not hasattr(self, "_table"):
            self._table = [self.strings.get(i, "").encode() for i in range(max(self.strings) + 1)]
        return self._table

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: their strings with a space between, as this vocabulary names no decoder."""
        return b" ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


class Step:
    """What a step of texts comes to: ids, the texts' offsets in them, and decoded texts."""

    def __init__(self, own: Codec, texts: atoms.Texts) -> None:
        self.own, self.texts = own, texts
        self.ids, self.at = texts.ids()

    def raw(self) -> list[memoryview]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        raw = memoryview(self.ids.astype("<u4").tobytes())
        return [raw[4 * a : 4 * b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def decoded(self) -> list[bytes]:
        """Each different atom is decoded once."""
        parts = [self.own.decode(x) for x in self.texts.values]
        numbers = self.texts.numbers
        if not all(self.texts.values):  # an atom without ids leaves no space
            full = np.fromiter(map(len, parts), np.int64, len(parts)) > 0
            keep = full[numbers]
            numbers, at = numbers[keep], np.concatenate([[0], np.cumsum(keep)])[self.texts.at]
        else:
            at = self.texts.at
        return [b" ".join(map(parts.__getitem__, numbers[a:b].tolist())) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, columns: Callable[[Step], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and what ``columns`` makes of the texts' ids; ``schema`` names these."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches, most=2_000_000):
            done = 0
            for texts in own.encoded(batch.column("text")):
                n = len(texts.at) - 1
                yield pa.record_batch([batch.column("doc_id").slice(done, n), *columns(Step(own, texts))], ["doc_id", *names])
                done += n
        common.release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {schema}")


def ids_and_text(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) and decoded text."""
    return encode(docs, path, lambda step: [pa.array(list(map(bytes, step.raw())), pa.binary()), pa.array([x.decode() for x in step.decoded()], pa.string())], "ids binary, decoded string")


def digest_columns(step: Step) -> list[pa.Array]:
    """sha256 of the ids and of the decoded text."""
    from hashlib import sha256

    return [pa.array([sha256(x).hexdigest() for x in step.raw()], pa.string()), pa.array([sha256(x).hexdigest() for x in step.decoded()], pa.string())]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the decoded text."""
    return encode(docs, path, lambda step: [pa.array(np.diff(step.at)), *digest_columns(step)], "n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array) and the digests of ids and decoded text."""

    def columns(step: Step) -> list[pa.Array]:
        lists = pa.ListArray.from_arrays(step.at.astype(np.int32), pa.array(step.ids.astype(np.int32)))
        return [pa.array(np.diff(step.at)), lists, *digest_columns(step)]

    return encode(docs, path, columns, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
