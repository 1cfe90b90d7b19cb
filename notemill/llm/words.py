"""Words of whole texts as numpy arrays: byte positions, document bounds and 64-bit hashes.

A task receives Arrow batches; ``slices`` cuts them by bytes, so memory follows the slice and the
longest single text, never the batch. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
PAD = 8
JOINED_WORDS = 1 << 16
LONG_WORD = 2048  # bytes from which a word is hashed by the C library instead of in steps of eight

# The bytes that separate words. Bytes from 0x80 on belong to other letters.
_BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_LETTERS_AND_DIGITS = (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100))

NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[list(_BLANKS)] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[list(_LETTERS_AND_DIGITS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(29)
_HALF = np.uint64(32)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that workers which wait for their next task hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@dataclass
class Words:
    """Word ``i`` is ``data[starts[i]:ends[i]]``; document ``d`` has words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def per_document(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        length = self.ends - self.starts
        view = byte_steps(self.data)
        out = (length.astype(np.uint64) + np.uint64(seed)) * _SECOND
        longest = int(min(length.max(initial=0), LONG_WORD))
        for step in range(0, longest, 8):
            at = slice(None) if step == 0 else np.flatnonzero(length > step)
            left = np.minimum(length[at] - step, 8)
            value = (out[at] ^ (view[self.starts[at] + step] & _MASKS[left])) * _MULTIPLIER
            out[at] = value ^ (value >> _SHIFT)
        for i in np.flatnonzero(length > LONG_WORD):
            whole = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = xxhash.xxh64_intdigest(whole, seed)
        return scramble(out)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one blank, and the offsets of the words in that string."""
        length = self.ends - self.starts
        offsets = np.zeros(len(length) + 1, dtype=np.int64)
        np.cumsum(length + 1, out=offsets[1:])
        out = np.full(offsets[-1], 0x20, dtype=np.uint8)
        for lo in range(0, len(length), JOINED_WORDS):  # a number per byte is held for these words only
            part = slice(lo, lo + JOINED_WORDS)
            from_start, to_start, size = self.starts[part], offsets[:-1][part], length[part]
            out[ranges(to_start, size)] = self.data[ranges(from_start, size)]
        return out.tobytes(), offsets

    def same_document(self, n: int) -> np.ndarray:
        """Positions that start ``n`` consecutive words of one document."""
        if len(self) < n:
            return np.zeros(0, dtype=np.int64)
        ok = np.ones(len(self), dtype=bool)
        last = self.first[1:]
        for back in range(1, n):
            at = last - back
            ok[at[at >= self.first[:-1]]] = False
        return np.flatnonzero(ok)


def byte_steps(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as one number each; ``data`` ends in PAD spare bytes."""
    return np.ndarray(len(data) - PAD + 1, dtype="<u8", buffer=data, strides=(1,))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MULTIPLIER
    return x ^ (x >> _SHIFT)


def split_bytes(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = False) -> Words:
    """Words of the documents ``raw[offsets[d]:offsets[d + 1]]``."""
    data = np.zeros(len(raw) + PAD, dtype=np.uint8)
    data[: len(raw)] = LOWER[raw] if lower else raw
    inside = is_word[data[: len(raw)]]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    begin[edges] = inside[edges]
    edges = offsets[1:][offsets[1:] > 0] - 1
    finish[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    return Words(data, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offsets of the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def split(texts: pa.Array, is_word: np.ndarray = NOT_BLANK, lower: bool = False) -> Words:
    return split_bytes(*bytes_of(texts), is_word, lower)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes, put together from runs of powers of two."""
    out, size, power, length = None, 0, hashes, 1
    while True:
        if n & length:
            count = len(hashes) - size - length + 1
            if count <= 0:
                return np.zeros(0, dtype=np.uint64)
            out = power[:count] if out is None else pair(out[:count], power[size : size + count])
            size += length
        if size == n:
            return out
        if len(power) <= length:
            return np.zeros(0, dtype=np.uint64)
        power = pair(power[:-length], power[length:])
        length *= 2


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return scramble(a * _SECOND + (b ^ _MULTIPLIER) * _MULTIPLIER)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    out, length = values, 1
    while length * 2 <= n:
        out = np.minimum(out[:-length], out[length:])
        length *= 2
    rest = n - length
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` for ``counts[0]`` numbers, then the same for the next."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
