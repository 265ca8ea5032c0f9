"""Vectorised views of Arrow string columns, for use inside tasks.

Everything here works on a bounded chunk of rows (about ``CHUNK`` bytes; one longer text makes
a chunk of its own), so a task's memory does not follow the size of its partition.  What a chunk has
used goes back to the system, as workers outlive their tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; drops powers beyond those of a usual chunk."""
    pa.default_memory_pool().release_unused()
    if "up" in _powers and len(_powers["up"]) > 8 * CHUNK:
        _powers.clear()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer of 64-bit hashes."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def byte_table(fold: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with fold, A-Z share the values of a-z."""
    t = mix((np.arange(256, dtype=U64) + U64(1)) * U64(_ODD))
    if fold:
        t[65:91] = t[97:123]
    return t


FOLDED, PLAIN = byte_table(True), byte_table(False)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


class Hasher:
    """Hashes of any byte ranges of a chunk, from one running sum."""

    def __init__(self, data: np.ndarray, table: np.ndarray = FOLDED):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=U64)
        self.sums[0] = 0
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]


def word_hash(word: str) -> int:
    """The mixed hash that ``Hasher`` with FOLDED gives for a word."""
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    h = Hasher(data)
    return int(mix(h.of(np.array([0]), np.array([len(data)])))[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of successive runs of whole texts."""
    data, off = buffers(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, side="right")) - 1)
        yield row, end, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end
    give_back()


def separators(kind: str) -> np.ndarray:
    """Which bytes part words.  white: 0x20 and 0x09-0x0D; alnum: ASCII but for digits and letters."""
    sep = np.zeros(256, dtype=bool)
    if kind == "white":
        sep[[32, 9, 10, 11, 12, 13]] = True
    else:
        sep[:128] = True
        sep[48:58] = sep[65:91] = sep[97:123] = False
    return sep


WHITE, ALNUM = separators("white"), separators("alnum")


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets by document) of the words of a chunk; none crosses documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~sep[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, inside[:-1]
    first = off[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, inside[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The document of each item, from the items' offsets by document."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
