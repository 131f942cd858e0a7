"""Vectorised hashing of words and n-grams over UTF-8 buffers (numpy).

A block is the bytes of a few texts, each with a line feed before it and one
after the last, so that nothing spans two texts unless the caller asks for it.
Prefix sums of ``table[byte] * P**i`` modulo 2**64 give the hash of any byte
range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 2**64)
BLOCK = 1 << 20

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _table(lower: bool) -> np.ndarray:
    t = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
    return t[_TO_LOWER] if lower else t


TABLE = _table(False)
TABLE_LOWER = _table(True)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, BLOCK + BLOCK // 4)
        out = []
        for base in (BASE, _INV):
            p = np.full(m, base, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit moves every output bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


class Block:
    """Bytes of the texts lo .. hi-1 of a batch; text k is data[starts[k]:ends[k]]."""

    def __init__(self, lo: int, texts: list[bytes]):
        self.lo, self.hi = lo, lo + len(texts)
        self.data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.starts = np.cumsum(np.r_[1, sizes[:-1] + 1])
        self.ends = self.starts + sizes

    def sums(self, table: np.ndarray = TABLE_LOWER) -> np.ndarray:
        """Prefix sums: hash of data[a:b] is (sums[b] - sums[a]) * P**-a."""
        x = table[self.data]
        x *= powers(len(x))[0]
        out = np.empty(len(x) + 1, U)
        out[0] = 0
        np.cumsum(x, out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word; line feeds part the texts."""
        blank = _IS_BLANK[self.data]
        edge = blank[1:] != blank[:-1]
        at = np.flatnonzero(edge) + 1
        return at[0::2], at[1::2]

    def words_in(self, starts: np.ndarray) -> np.ndarray:
        """For word starts: words before each text's start, and one more for the end."""
        return np.r_[np.searchsorted(starts, self.starts), len(starts)]


def range_hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * powers(len(sums))[1][a])


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x if x is not None else b"" for x in column.to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[Block]:
    """Blocks of about ``size`` bytes; a longer text has a block of its own."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield Block(lo, texts[lo:i])
            lo, held = i, 0
        held += len(t) + 1
    if lo < len(texts):
        yield Block(lo, texts[lo:])


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[k]:bounds[k+1]]; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])
