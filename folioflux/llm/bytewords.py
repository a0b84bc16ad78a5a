"""Words of whole Arrow text columns as 64-bit hashes, in vector operations over their UTF-8 bytes.

Only A-Z are lower-cased. A byte table says which bytes belong to words; as every character beyond ASCII is in words in both
tables, a byte table decides what the patterns over characters do. Memory is bounded by SEGMENT, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
#: Rows are handed to the vector operations in slices of about so many bytes.
SLICE_BYTES = 4 << 20

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_POWERS: dict[str, np.ndarray] = {}


def _table(word: "callable") -> np.ndarray:
    """0 for bytes between words, else the lower-cased byte."""
    return np.array([(b + 32 if 65 <= b <= 90 else b) if word(b + 32 if 65 <= b <= 90 else b) else 0 for b in range(256)], np.uint8)


#: [^\x20\x09-\x0D]+ ; byte 0 belongs to words there and gets a value of its own.
BLANK_SEPARATED = _table(lambda b: b not in (0x20, *range(0x09, 0x0E)))
BLANK_SEPARATED[0] = 65
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and those of its inverse."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for key, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            out = np.empty(n, np.uint64)
            out[0], done, step = 1, 1, base
            while done < n:
                more = min(done, n - done)
                out[done : done + more] = out[:more] * np.uint64(step)
                done, step = done + more, step * step & _MASK
            _POWERS[key] = out
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of a text column, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of at most about SEGMENT bytes that don't fall within a word."""
    a, end = 0, len(data)
    while a < end:
        step = SEGMENT
        while True:
            b = min(a + step, end)
            if b == end:
                break
            k = int(np.searchsorted(offsets, b, "right")) - 1
            inside = int(offsets[k]) if offsets[k] > a else a
            gaps = np.flatnonzero(table[data[max(a, inside) : b]] == 0)
            cut = max(inside, max(a, inside) + int(gaps[-1]) + 1 if len(gaps) else a)
            if cut > a:
                b = cut
                break
            step *= 2  # one word as long as the segment
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, where each begins (a byte), and n + 1 bounds: row i has words bounds[i] to bounds[i + 1]."""
    hashes, begins = [], []
    for a, b in _pieces(data, offsets, table):
        up, down = powers(max(SEGMENT, b - a))
        low = table[data[a:b]]
        inside = low != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[rows] = inside[rows]
        at = np.flatnonzero(first)
        if len(at):
            hashes.append(mix(np.add.reduceat(low * up[: b - a], at) * down[at]))
            begins.append(at + a)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(begins) if begins else np.empty(0, np.int64)
    return h, s, np.searchsorted(s, offsets)
