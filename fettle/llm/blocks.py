"""Words of many texts at once: numpy over the bytes of an Arrow string column.

A column is worked in blocks of whole texts of about ``LIMIT`` bytes, so that memory follows the limit or the one longest
text, not the batch. Null texts count as empty. Words are found on bytes: every byte over 0x7F belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LIMIT = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of anything but blanks: space and 0x09 to 0x0D.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Words of digits, letters a-z (after lower-casing) and bytes over 0x7F.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True

_powers = [np.ones(1, U), np.ones(1, U)]


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each text in them, one more than there are texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), at


def blocks(column, limit: int = LIMIT) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of whole texts; a text over ``limit`` is a block of its own."""
    data, at = column_bytes(column)
    first, n = 0, len(at) - 1
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each text the number of words before it (one more at the end)."""
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads, tails = offsets[:-1], offsets[1:] - 1
    before[heads[heads < len(data)]] = False
    after[tails[tails >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (one-to-one)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, LIMIT + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    pair = _powers[0][:n], _powers[1][:n]
    if n > 4 * LIMIT:  # not kept for the sake of one long text
        _powers[:] = [np.ones(1, U), np.ones(1, U)]
    return pair


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: equal bytes, equal hash, wherever they stand."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte the number of characters that start before or at it."""
    return np.cumsum((data & 0xC0) != 0x80)
