"""Words, word hashes and word n-grams of Arrow text columns, in numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. Null texts
count as empty. Hashes have 64 bits: a polynomial over the bytes (prefix sums,
so one pass serves all words), then a finalising mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = {"byte": 0x9E3779B97F4A7C15 | 1, "word": 0xC2B2AE3D27D4EB4F | 1}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(kind)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[kind]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[kind] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 row offsets."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets."""
    if not len(column):
        return
    data, offsets = as_bytes(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of some rows: byte ``start`` and ``end``, ``row``, ``hash``; ``first[r]`` is row r's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = ~_SPACE[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        edge = word.copy()
        edge[1:] &= ~word[:-1] | cut[1:n]
        self.start = np.flatnonzero(edge)
        edge = word
        edge[:-1] &= ~word[1:] | cut[1:n]
        self.end = np.flatnonzero(edge) + 1
        self.first = np.searchsorted(self.start, offsets, "left")
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        power, inverse = _powers("byte", n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_BYTE[self.data] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(U))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether they lie in one row."""
        n = max(0, len(self) - size + 1)
        if not n:
            return np.zeros(0, U), np.zeros(0, bool)
        return gram_hashes(self.hash, size), self.row[:n] == self.row[size - 1 :]


def gram_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, U)
    power, inverse = _powers("word", n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(word_hash * power[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * inverse[: n - size + 1] + U(size))


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list<int64> column."""
    sizes = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=sizes[1:])
    flat = np.concatenate(parts).view(np.int64) if len(parts) and sizes[-1] else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))
