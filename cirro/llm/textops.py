"""Vectorised byte work on Arrow string columns (numpy inside tasks).

Texts are taken a chunk of rows at a time as one byte buffer with row
starts, so that word splitting and hashing cost a few array passes and no
Python loop per row or word.  A chunk holds whole rows and about
``CHUNK_BYTES`` bytes (one longer text is a chunk of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)                      # odd, so it has an inverse modulo 2^64
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POWERS[key] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def byte_table(seed: int) -> np.ndarray:
    """256 random odd 64-bit values: what a byte counts for in a rolling hash."""
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_TABLE = byte_table(11)
_TABLE2 = byte_table(12)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads a 64-bit value over all bits (in a new array)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any substrings of one buffer, by prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, table: np.ndarray = _TABLE):
        n = len(data)
        up, self._down = _powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(table[data] * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start])


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, and its peak would stay with it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        lib = ctypes.CDLL(None)
        lib.malloc_trim
        return lib
    except (OSError, AttributeError):                      # no glibc: nothing to trim
        return None


_LIBC = _libc()


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets in them); null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    row, n = 0, len(column)
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end
    give_back()


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ((48, 57), (65, 90), (97, 122), (128, 255)):
        t[a:b + 1] = True
    return t


WORD_BYTE = _word_bytes()                                   # ASCII letters and digits, and all of a multi-byte character


def runs(flag: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of true flags; no run crosses a row."""
    n = len(flag)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True                              # a row start (may be n for empty last rows)
    first = first[:n]
    begin = flag.copy()
    begin[1:] &= ~flag[:-1] | first[1:]
    start = np.flatnonzero(begin)
    stop = flag.copy()
    stop[:-1] &= ~flag[1:] | first[1:]
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words: runs of word bytes."""
    return runs(WORD_BYTE[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of each word, in text order."""
    start, end, row = words(data, offsets)
    return Rolling(data).of(start, end), row


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of the word k-grams in text order.

    A row with 1 to k-1 words has one shingle of all its words; a row
    without words has none.
    """
    h, row = word_hashes(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(count)))
    n = len(h)
    out_count = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate(([0], np.cumsum(out_count)))
    if n == 0:
        return h, out_at
    roll = h.copy()
    for i in range(1, k):
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[:n - i] = h[i:]
        inside = np.arange(n) + i < at[row + 1]
        roll = np.where(inside, mix(roll * np.uint64(0x9E3779B97F4A7C15) + nxt), roll)
    keep = (np.arange(n) - at[row] < out_count[row])
    return roll[keep], out_at


def _classes() -> np.ndarray:
    t = np.full(256, 2, dtype=np.uint8)                     # punctuation and symbols
    t[WORD_BYTE] = 1
    t[[9, 10, 11, 12, 13, 32]] = 0
    return t


CLASS = _classes()


def class_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, class) of the runs of word bytes (1) and of symbols (2); no run crosses a row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z
    cls = CLASS[data]
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = cls[1:] != cls[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    start, end = at[:-1], at[1:]
    kind = cls[start].astype(np.int64)
    keep = kind > 0
    start, end, kind = start[keep], end[keep], kind[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1, kind


def restart_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags (one more than bytes) of where units begin: texts, and blanks between two characters that are none.

    A byte-level tokenizer starts anew there: no pre-token holds a blank after something
    else.  (A character before the blank is taken if its bytes show that it is no white space.)
    """
    begin = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 3:
        one, two, here, after = data[1:-2], data[:-3], data[2:-1], data[3:]
        solid = (one > 32) & (one < 127) | (one >= 128) & (two >= 0xC3) & (two <= 0xDF)
        begin[2:-2] = (here == 32) & solid & (after != 32)
        begin[np.maximum(offsets[1:] - 1, 0)] = False                # a blank at the end of a text
    begin[offsets] = True
    return begin


def row_ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is alone."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= limit:
            total += sizes[end]
            end += 1
        yield at, end
        at = end
