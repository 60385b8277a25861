"""Words of Arrow text columns as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over random 64-bit numbers of its bytes modulo 2**64,
read from running sums (so all words of a batch are hashed at once), then mixed.  Two
words share a hash with probability about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M64 = (1 << 64) - 1


def splitmix(n: int, seed: int) -> np.ndarray:
    """n numbers of the splitmix64 sequence."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(z)


def mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_LETTERS = splitmix(256, 11)
for _c in range(65, 91):  # A-Z as a-z
    _LETTERS[_c] = _LETTERS[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: What parts the terms of a search: all of ASCII but digits and letters.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = int(splitmix(1, 12)[0]) | 1
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), np.uint64(base), dtype=np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if len(have) <= 1 << 22:  # longer tables serve one very long text only
            _powers[base] = have
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def word_hashes(column: pa.Array, window: int = 1 << 20, space: np.ndarray = _SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, word hashes, offsets of the rows' words) for runs of rows of about ``window`` bytes.

    ``space`` says of each byte whether it parts words.
    """
    data, offsets = utf8(column)
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + window, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, *_hash_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], space)
        i = j


def _hash_rows(b: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    if len(b) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~space[b]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(b)]] = False  # words do not run over into the next row
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(len(b) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTERS[b] * _powers_of(_BASE, len(b))[: len(b)], out=sums[1:])
        back = _powers_of(pow(_BASE, -1, 1 << 64), len(b))
        h = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offsets)
