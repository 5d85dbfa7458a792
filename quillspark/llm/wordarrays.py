"""Words of many texts as numpy arrays: split, hash and join without a Python object per word.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the ASCII white space; a text never
shares a word with its neighbour.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE_INVERSE = np.uint64(pow(int(_BYTE_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2^64 for i < n; the table grows on demand and is kept up to 4 Mi entries."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        size = max(n, 1 << 20)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        if size <= 1 << 22:
            _POWERS[int(base)] = table
    return table[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """starts, ends: byte positions of each word in ``data``; first[i]:first[i+1] are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(data)
        space = _SPACE[data]
        opens = ~space
        closes = opens.copy()
        if n:
            inner = offsets[(offsets > 0) & (offsets < n)]
            edge = np.zeros(n, dtype=bool)
            edge[inner] = True
            edge[0] = True
            opens[1:] &= space[:-1] | edge[1:]
            closes[:-1] &= space[1:] | edge[1:]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes: eight at a time through ``mix``, XXH64 for words of over 512 bytes.

        No sum or product of the bytes, so words that repeat a pattern in another order don't collide.
        """
        size = self.ends - self.starts
        h = size.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        padded = np.append(self.data, np.zeros(8, np.uint8))
        lanes = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
        long = np.flatnonzero(size > 512)
        at, todo = 0, np.flatnonzero(size <= 512)
        while len(todo):
            lane, left = lanes[self.starts[todo] + at], size[todo] - at
            short = left < 8
            lane[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
            h[todo] = mix((h[todo] ^ lane) + np.uint64(0x9E3779B97F4A7C15))
            at += 8
            todo = todo[left > 8]
        for i in long.tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes(), 7)
        return h

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what a stands for followed by what b stands for."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + (b ^ (b >> np.uint64(31))) + np.uint64(0x2545F4914F6CDD1D))


def rolled(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words; n - k + 1 of them, those across texts included.

    Runs of 1, 2, 4, ... words are joined in pairs, and k is put together of them, so every join goes through ``mix``.
    """
    n = len(word_hashes)
    if n < k or k < 1:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, run = None, 0, 1, word_hashes
    while True:
        if k & power:
            out = run if out is None else joined(run[: n - have - power + 1], out[power:])
            have += power
        if have == k:
            return mix(out)
        run = joined(run[:-power], run[power:])
        power *= 2


def text_buffer(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return (_LOWER[data] if lower else data), offsets - offsets[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    return Words(*text_buffer(column, lower))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have ``most`` bytes at most, or of one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose row i is the bytes of values[offsets[i]:offsets[i+1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of packed: all values, and the n + 1 offsets."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    width = np.dtype(dtype).itemsize
    return np.frombuffer(raw.tobytes(), dtype=dtype), (offsets - offsets[0]) // width if len(column) else np.zeros(1, np.int64)
