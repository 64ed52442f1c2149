"""Whole batches of text as numpy arrays of code points.

The workers of this subpackage never loop over characters in Python: a block of texts is
joined, decoded once to 32-bit code points, and classified through lookup tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Code points that the tables cover; the rest (rare scripts, private use) are taken as they are.
SPAN = 0x20000
#: Characters in a block; a longer text is a block of its own.
BLOCK_CHARS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x += _MIX
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def flags(kind: str) -> np.ndarray:
    """Boolean table over code points for a method of str, as isspace, isalnum, isdecimal."""
    return np.fromiter((getattr(chr(i), kind)() for i in range(SPAN)), dtype=bool, count=SPAN)


@cache
def lower_table() -> np.ndarray:
    out = np.arange(SPAN, dtype=np.uint32)
    for i in range(SPAN):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


@cache
def fold_table() -> np.ndarray:
    """Lower case without accents; accent marks themselves become 0."""
    out = np.arange(SPAN, dtype=np.uint32)
    for i in range(0x80, 0x3100):
        base = [c for c in unicodedata.normalize("NFD", chr(i)) if not unicodedata.combining(c)]
        if not base:
            out[i] = 0
        elif len(base) == 1 and ord(base[0]) < SPAN:
            out[i] = ord(base[0])
    return lower_table()[np.minimum(out, SPAN - 1)]


@cache
def noise_table() -> np.ndarray:
    """A well mixed 64-bit value for each code point."""
    return mix64(np.arange(SPAN, dtype=np.uint64) + np.uint64(1 << 40))


@cache
def powers() -> np.ndarray:
    """Powers of an odd number modulo 2**64, the place values of the fingerprints."""
    out = np.full(1 << 16, 0xD6E8FEB86659FD93, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def look(tab: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``tab[codes]``; code points beyond the tables take the value of the last entry."""
    return tab[np.minimum(codes, SPAN - 1)] if codes.size and codes.max() >= SPAN else tab[codes]


def map_codes(tab: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Like ``look`` for tables of code points: those beyond stay as they are."""
    return np.where(codes < SPAN, tab[np.minimum(codes, SPAN - 1)], codes) if codes.size and codes.max() >= SPAN else tab[codes]


def noise(codes: np.ndarray) -> np.ndarray:
    if codes.size and codes.max() >= SPAN:
        return np.where(codes < SPAN, noise_table()[np.minimum(codes, SPAN - 1)], mix64(codes.astype(np.uint64) + np.uint64(1 << 40)))
    return noise_table()[codes]


def codes_of(texts: list[str], separator: str = "\n") -> np.ndarray:
    """Code points of all texts, each ended by the separator."""
    return np.frombuffer((separator.join(texts) + separator).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def place_values(position: np.ndarray) -> np.ndarray:
    p = powers()
    if position.size and position.max() >= p.size:
        high = (position >> 16).astype(np.uint64)
        return p[position & 0xFFFF] * (high * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
    return p[position]


def fingerprints(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the runs ``values[s:s+n]`` (values already mixed), order and length included.

    The runs must be ascending and not overlap; empty runs get the fingerprint of nothing.
    """
    out = np.zeros(starts.size, dtype=np.uint64)
    some = lengths > 0
    s, n = starts[some], lengths[some]
    if s.size:
        total = int(n.sum())
        first = np.zeros(s.size, dtype=np.int64)
        np.cumsum(n[:-1], out=first[1:])
        within = np.arange(total, dtype=np.int64) - np.repeat(first, n)
        taken = values if total == values.size else values[np.repeat(s, n) + within]
        out[some] = np.add.reduceat(taken * place_values(within), first)
    return mix64(out ^ (lengths.astype(np.uint64) << np.uint64(48)))


def blocks(column: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of stretches of the column with about ``limit`` characters."""
    texts = column.to_pylist()
    first, chars = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > first and chars + size > limit:
            yield first, texts[first:i]
            first, chars = i, 0
        chars += size
    if first < len(texts):
        yield first, texts[first:]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's BIGINT."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
