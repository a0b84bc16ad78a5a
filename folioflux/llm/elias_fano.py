"""Elias-Fano sequences over numpy arrays that can lie in a memory-mapped file; all operations take and give whole arrays."""

from __future__ import annotations

import json

import numpy as np

_ONE = np.uint64(1)
_ALL = ~np.uint64(0)
_LOWS, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: The place of the k-th one bit of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64).ravel()


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th (from 0) one bit of each word: byte counts added up in one multiplication, then a table of bytes."""
    k = k.astype(np.uint64)
    n = word - ((word >> _ONE) & np.uint64(0x5555555555555555))
    n = (n & np.uint64(0x3333333333333333)) + ((n >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((n + (n >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _LOWS
    shift = np.bitwise_count((((k * _LOWS) | _HIGHS) - upto) & _HIGHS).astype(np.uint64) << np.uint64(3)
    left = k - ((upto << np.uint64(8)) >> shift & np.uint64(0xFF))
    byte = (word >> shift) & np.uint64(0xFF)
    return shift.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + left).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of n numbers below `universe`: their low bits packed, their high bits as gaps between ones."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.universe, self.low, self.high, self.ones = n, universe, low, high, ones
        self.bits = low_bits(n, universe)

    @classmethod
    def of(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if universe is None and n else universe or 1
        bits = low_bits(n, universe)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + bits > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = n + (universe >> bits) + 2
        high = np.zeros(-(-words // 64) + 1, np.uint64)
        np.bitwise_or.at(high, places >> 6, _ONE << (places & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(n, universe, low, high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        rest = np.where(shift + np.uint64(self.bits) > 64, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (out | rest) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place in the high bits of the k-th (from 0) one, or zero."""
        before = self.ones if ones else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        bits = self.high[word]
        return word * 64 + select_in_word(bits if ones else bits ^ _ALL, k - before[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, np.uint64)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first number >= x (n if there is none) and whether it equals x."""
        x = np.asarray(x, np.uint64)
        if not len(x) or not self.n:
            return np.full(len(x), self.n), np.zeros(len(x), bool)
        beyond = x >= np.uint64(self.universe)
        x = np.where(beyond, np.uint64(0), x)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        # numbers with high part h are the ones between zero h - 1 and zero h
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) + 1, 0)
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        after = np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        bits = (self.high[word] >> shift) | after
        run = np.bitwise_count(bits & ~(bits + _ONE)).astype(np.int64)  # ones before the first zero
        long = run >= 64
        if long.any():
            run[long] = self._select(h[long], False) - begin[long]
        start = begin - h
        end = start + run
        want = x & np.uint64((1 << self.bits) - 1)
        a, b = start.copy(), end.copy()
        while True:  # a binary search among the few numbers with this high part
            active = np.flatnonzero(a < b)
            if not len(active):
                break
            m = (a[active] + b[active]) >> 1
            less = self._low(m) < want[active]
            a[active[less]] = m[less] + 1
            b[active[~less]] = m[~less]
        equal = a < end
        equal[equal] = self._low(a[equal]) == want[equal]
        return np.where(beyond, self.n, a), equal & ~beyond

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.size": np.array([self.n, self.universe], np.int64), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones}

    @classmethod
    def from_arrays(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, universe = arrays[f"{name}.size"].tolist()
        return cls(n, universe, arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])


def low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the length of a JSON list of names, types and lengths, the list, then the arrays, each from a multiple of 64 bytes."""
    parts, at, listed = [], 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        listed.append([name, a.dtype.str, len(a), at])
        parts += [raw, b"\0" * (-len(raw) % 64)]
        at += len(raw) + -len(raw) % 64
    head = json.dumps(listed).encode()
    head += b" " * (-(8 + len(head)) % 64)
    return b"".join([len(head).to_bytes(8, "little"), head, *parts])


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of such a file, memory-mapped."""
    whole = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(whole[:8].tobytes(), "little")
    listed = json.loads(whole[8 : 8 + size].tobytes())
    data = whole[8 + size :]
    return {name: np.asarray(data[at : at + n * np.dtype(kind).itemsize]).view(kind) for name, kind, n, at in listed}
