"""Elias-Fano sequences over flat arrays, and files of named arrays that tasks map into memory."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

U64 = np.uint64
_ONE = U64(1)
# position of the r-th set bit of each byte
_SELECT = np.zeros((256, 8), dtype=np.uint8)
for _b in range(256):
    for _r, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _SELECT[_b, _r] = _p


# a byte value in each byte of a word
_EACH = {v: U64(v * 0x0101010101010101) for v in (0x01, 0x0F, 0x33, 0x55, 0x80)}


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit of that rank in each 64-bit word."""
    x = words - ((words >> U64(1)) & _EACH[0x55])
    x = (x & _EACH[0x33]) + ((x >> U64(2)) & _EACH[0x33])
    sums = ((x + (x >> U64(4))) & _EACH[0x0F]) * _EACH[0x01]  # byte j: set bits in bytes 0 to j
    rank = rank.astype(U64)
    full = ((rank * _EACH[0x01] | _EACH[0x80]) - sums) & _EACH[0x80]  # the top bit of each byte whose sum is not above the rank
    shift = np.bitwise_count(full).astype(U64) << U64(3)
    before = ((sums << U64(8)) >> shift) & U64(255)
    return shift.astype(np.int64) + _SELECT[(words >> shift) & U64(255), rank - before]


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of values below the universe."""
    n = len(values)
    bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    values = values.astype(U64)
    low = np.zeros(8, dtype=np.uint8)
    if bits and n:
        planes = np.empty((n, bits), dtype=np.uint8)
        for j in range(bits):
            planes[:, j] = (values >> U64(j)) & _ONE
        low = np.concatenate((np.packbits(planes.ravel(), bitorder="little"), low))
    high = (values >> U64(bits)).astype(np.int64) + np.arange(n)
    size = n + (max(1, universe) >> bits) + 2
    flags = np.zeros(-(-size // 64) * 64, dtype=bool)
    flags[high] = True
    packed = np.packbits(flags, bitorder="little").view(U64)
    ones = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
    return {"low": low, "high": packed, "ones": ones, "shape": np.array([n, bits], dtype=np.int64)}


class Sequence:
    """A view of encoded arrays; queries are vectors."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["shape"])
        self.high, self.ones = arrays["high"], arrays["ones"]
        low = arrays["low"]
        self.low = np.ndarray(len(low) - 7, dtype="<u8", buffer=low, strides=(1,)) if len(low) >= 8 else None
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=U64)
        at = i * self.bits
        return (self.low[at >> 3] >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        where = word * 64 + _in_word(self.high[word], i - self.ones[word])
        return ((where - i).astype(U64) << U64(self.bits)) | self.lows(i)

    def _ends(self, h: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most h."""
        word = np.searchsorted(self.zeros, h, side="right") - 1
        return word * 64 + _in_word(~self.high[word], h - self.zeros[word]) - h

    @staticmethod
    def _least(value, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first index of each range whose value is not below the wanted one, or the range's end."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = value(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """The index of each value, within its range from lo to hi if given; -1 where it is not there."""
        out = np.full(len(x), -1, dtype=np.int64)
        lo = np.zeros(len(x), dtype=np.int64) if lo is None else lo
        hi = np.full(len(x), self.n, dtype=np.int64) if hi is None else hi
        wide = hi - lo > 4  # by high part; the values of short ranges are compared whole
        for value, at in ((self.access, np.flatnonzero(~wide)), (self.lows, np.flatnonzero(wide))):
            if not len(at):
                continue
            want, start, end = x[at], lo[at], hi[at]
            if value == self.lows:
                h = np.minimum((want >> U64(self.bits)).astype(np.int64), int(self.zeros[-1]) - 1)
                want = want & U64((1 << self.bits) - 1)
                start, end = np.maximum(start, np.where(h > 0, self._ends(np.maximum(h - 1, 0)), 0)), np.minimum(end, self._ends(h))
            place = self._least(value, want, start, end)
            k = np.flatnonzero(place < end)
            k = k[value(place[k]) == want[k]]
            out[at[k]] = place[k]
        return out


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file in a folder of any file system; a repeated write of a retried task replaces it whole."""
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    system.move(part, f"{path}/{name}")


def map_arrays(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; a file in a remote store is copied to the task's folder first."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    local = f"{path}/{name}"
    if not isinstance(system, fs.LocalFileSystem):
        home = os.path.join(tempfile.gettempdir(), "lodestone-" + str(abs(hash(folder))))
        os.makedirs(home, exist_ok=True)
        local = os.path.join(home, name)
        if not os.path.exists(local):
            part = f"{local}.{uuid.uuid4().hex}"
            fs.copy_files(f"{path}/{name}", part, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, local)
    whole = np.asarray(np.memmap(local, dtype=np.uint8, mode="r"))
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    out = {}
    for k, (at, dtype, n) in head.items():
        begin = 8 + size + at
        out[k] = whole[begin : begin + n * np.dtype(dtype).itemsize].view(dtype)
    return out


def planes(values: np.ndarray) -> bytes:
    """Values below 2**64 as byte planes, the high planes that are zero left out; the first byte says how many there are."""
    by = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    n = 8
    while n > 1 and not by[:, n - 1].any():
        n -= 1
    return bytes([n]) + np.ascontiguousarray(by[:, :n].T).tobytes()


def from_planes(blob: bytes) -> np.ndarray:
    n = blob[0]
    by = np.frombuffer(blob, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((by.shape[1], 8), dtype=np.uint8)
    out[:, :n] = by.T
    return out.view("<u8").ravel()
