"""Vectorised scans over the UTF-8 bytes of many texts at once (numpy, inside Arrow tasks).

Texts are looked at as one byte buffer plus offsets, which is how Arrow hands them over, so splitting into
words and hashing them costs a few passes over the buffer and no Python object per word.  A null text is
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step looks at (a longer text is a step of its own).
STEP_BYTES = 400_000
#: Entries of a table of powers that a worker keeps.
KEPT_POWERS = 2_100_000

_P = 0x9E3779B97F4A7C15  # an odd multiplier, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_class(chars: str) -> np.ndarray:
    """A table of 256 flags from a regular-expression class such as ``[^\\x20\\x09-\\x0D]``; bytes from 0x80
    up are parts of characters outside ASCII and belong to every negated class."""
    import re

    return np.array([b >= 0x80 or bool(re.match(chars, chr(b))) for b in range(256)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, starting at 0."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of at most ``most`` bytes or a single text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def power_table(base: int, n: int) -> np.ndarray:
    """Powers from 0 to n - 1; a worker keeps those that usual steps need, and makes longer tables anew."""
    key = str(base)
    if n <= KEPT_POWERS and key in _powers and len(_powers[key]) >= n:
        return _powers[key][:n]
    out = np.full(max(n, STEP_BYTES), base, np.uint64)
    out[0] = 1
    out = np.cumprod(out)
    if n <= KEPT_POWERS:
        _powers[key] = out
    return out[:n]


def powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """Powers at any places below 2**32, from two short tables."""
    low, high = power_table(base, 65536), np.full(int(at.max()) // 65536 + 1 if len(at) else 1, pow(base, 65536, 1 << 64), np.uint64)
    high[0] = 1
    return low[at & 65535] * np.cumprod(high)[at >> 16]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit over 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of a polynomial modulo 2**64; see :func:`span_hash`."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power_table(_P, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span that doesn't depend on where it stands."""
    return mix((prefix[ends] - prefix[starts]) * power_table(_P_INV, len(prefix))[starts] + (ends - starts).astype(np.uint64))


#: Primes below 2**31, and a base for each.
MODULI = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_220_703_125))


def residues(base: int, modulus: int, n: int) -> np.ndarray:
    """Powers of ``base`` from 0 to n - 1 modulo a prime below 2**31; kept as :func:`power_table` keeps its own."""
    key = f"{base} {modulus}"
    if n <= KEPT_POWERS and key in _powers and len(_powers[key]) >= n:
        return _powers[key][:n]
    size = max(n, STEP_BYTES)
    out = np.empty(size, np.uint32)
    out[0], done = 1, 1
    while done < size:
        more = min(done, size - done)
        out[done : done + more] = out[:more].astype(np.uint64) * np.uint64(pow(base, done, modulus)) % np.uint64(modulus)
        done += more
    if n <= KEPT_POWERS:
        _powers[key] = out
    return out[:n]


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of the bytes of each span, equal only for equal bytes but by chance: polynomials modulo two primes.  (A
    polynomial modulo 2**64 gives certain different words of over a thousand letters one value, whatever its base.)"""
    out = np.zeros(len(starts), np.uint64)
    for modulus, base in MODULI:
        m = np.uint64(modulus)
        terms = np.multiply(data.astype(np.uint16) + np.uint16(1), residues(base, modulus, len(data)), dtype=np.uint64)
        if len(data) >= 1 << 24:
            terms %= m  # sums of fewer terms fit 63 bits as they are
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        own = (total[ends] - total[starts]) % m * residues(pow(base, -1, modulus), modulus, len(data) + 1)[starts] % m
        out = (out << np.uint64(32)) | own
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text, and the n + 1 offsets of the texts
    in them."""
    flags = is_word[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(flags)
    before[1:], before[:1] = flags[:-1], False
    before[edge] = False
    starts = np.flatnonzero(flags & ~before)
    after = np.empty_like(flags)
    after[:-1], after[-1:] = flags[1:], False
    after[edge[edge > 0] - 1] = False
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z lower-cased, and the offsets of the texts in these."""
    starts, ends, at = word_spans(data, offsets, is_word)
    return word_codes(LOWER[data], starts, ends), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``size`` words; of a text with fewer words, but not
    none, the one hash of all its words."""
    words, at = word_hashes(data, offsets, is_word)
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        total += words[i : i + len(total)] * power_table(_P, size + 1)[i]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(total[a : b - size + 1]))
        elif b > a:
            short = words[a:b] * power_table(_P, size + 1)[: b - a]
            out.append(mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
