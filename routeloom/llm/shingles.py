"""Words and word shingles of Arrow string columns, hashed a slice of rows at a time.

A word is a maximal run of ASCII letters, digits and non-ASCII characters in the lower-cased text.
A shingle is `n` consecutive words; a text of 1 to n-1 words has one shingle, its whole word list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
SLICE_BYTES = 1 << 20
U = np.uint64
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = U(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_PLACE = mix(np.arange(1, 65, dtype=U) * U(0x8CB92BA72F3D8DD7)) | U(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            row = np.full(size, base, U)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def row_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one long text stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_hashes(lowered: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each row the range of its words (len(rows) + 1 offsets)."""
    raw, at = flat_bytes(lowered)
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    cut = np.zeros(n + 2, bool)
    cut[at + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut[1:]))
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts])
    return words, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each shingle in text order, and for each row the range of its shingles."""
    count = np.diff(at)
    if not len(words):
        return words, np.zeros(len(at), np.int64)
    first, last = np.repeat(at[:-1], count), np.repeat(at[1:], count)
    i = np.arange(len(words))
    total = np.zeros(len(words), U)
    for k in range(n):
        j = i + k
        total += np.where(j < last, words[np.minimum(j, len(words) - 1)], U(0)) * _PLACE[k]
    valid = (i + n <= last) | (i == first)
    return mix(total[valid]), np.concatenate([[0], np.cumsum(valid)])[at]


def shingle_set(lowered: str, n: int = 5) -> set[tuple[str, ...]]:
    """The shingles themselves, for exact checks."""
    words = WORD.findall(lowered)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
