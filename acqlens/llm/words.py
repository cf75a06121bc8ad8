"""Word and shingle arrays over Arrow string batches.

All functions are vectorised over a slice of documents: the texts stay one
UTF-8 byte array and words are (start, end) byte ranges in it. Word and shingle
keys are 64-bit hashes that depend only on the bytes, so every task computes the
same key for the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19  # text handled at once (about 40 MB of arrays); a longer document makes a slice of its own
GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words; the same on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(GOLDEN))


BYTE_KEY = stream(1, 256)
STEP = np.uint64(0xA0761D6478BD642F)  # odd: powers never vanish


def byte_table(keep: bytes | None = None, drop: bytes | None = None) -> np.ndarray:
    """Which bytes belong to words: those in ``keep`` and all non-ASCII ones, or all but ``drop``."""
    table = np.zeros(256, dtype=bool)
    if drop is None:
        table[np.frombuffer(keep or b"", dtype=np.uint8)] = True
        table[0x80:] = True
    else:
        table[:] = True
        table[np.frombuffer(drop, dtype=np.uint8)] = False
    return table


ALNUM = byte_table(keep=b"0123456789abcdefghijklmnopqrstuvwxyz")  # for lower-cased text
NON_SPACE = byte_table(drop=b"\x20\x09\x0a\x0b\x0c\x0d")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end and the n + 1 document offsets in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(offsets) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers are kept between tasks and stages, and
    what one operator's arrays used would otherwise stay with the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows whose text is at most ``limit`` bytes (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(size)
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


@dataclass
class Words:
    """Words of a slice: byte ranges, hashes, and for document d the range first[d]:first[d + 1]."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def keys(self) -> np.ndarray:
        """One 64-bit key per word: a polynomial over its bytes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        head = np.concatenate([[0], np.cumsum(length)[:-1]])
        place = np.arange(int(length.sum())) - np.repeat(head, length)
        powers = np.full(int(length.max()) + 1, STEP, dtype=np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        values = BYTE_KEY[self.buffer[place + np.repeat(self.start, length)]] * powers[place]
        return mix(np.add.reduceat(values, head))


def split(column: pa.Array, table: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run never crosses a document's border."""
    buffer, offsets = text_bytes(column)
    return split_bytes(buffer, offsets, table[buffer] if len(buffer) else np.zeros(0, dtype=bool))


def split_bytes(buffer: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes that are ``inside`` a word."""
    n = len(buffer)
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return Words(buffer, start, end, np.searchsorted(start, offsets))


def windows(keys: np.ndarray, first: np.ndarray, size: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all ``size``-word windows, their first words and the document bounds in the result.

    With ``short`` a document of fewer than ``size`` words has one window of all its words.
    """
    n, place = len(keys), np.arange(len(keys))
    last = np.repeat(first[1:], np.diff(first))
    valid = place + size <= last
    if short:
        valid |= place == np.repeat(first[:-1], np.diff(first))
    at = place[valid]
    stop = last[valid]
    value = np.zeros(len(at), dtype=np.uint64)
    factor = stream(2, size)
    for j in range(size):
        there = at + j < stop
        value[there] += (keys[at[there] + j] ^ factor[j]) * (factor[j] | np.uint64(1))
    return mix(value), at, np.searchsorted(at, first) if n else np.zeros(len(first), dtype=np.int64)


def shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the word shingles of lower-cased texts and the document bounds.

    Words are runs of ASCII letters and digits and of non-ASCII characters; a
    text of fewer than ``size`` words has one shingle of all its words, a text
    without words none.
    """
    words = split(pc.utf8_lower(column), ALNUM)
    value, _, bounds = windows(words.keys(), words.first, size, short=True)
    return value, bounds
