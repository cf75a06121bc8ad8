"""Periodic run detection by block convolution.

A run is a longest stretch of words with a least period q, at least LEAST_WORDS words
and EXPONENT periods long. For every dyadic scale B (from 8 words) the words are cut
into blocks of B. A run with a period in [B, 2 B) holds a whole block that comes
again q words later (its length less q is at least 2 B - 1), and so does one with a
shorter period at the first scale. So each block is looked for in the window that follows it:
the sum of squared differences of word numbers at every distance is a convolution,
computed by a number theoretic transform in exact integers modulo a prime. A zero
modulo the prime is confirmed on the words. Blocks with a word that does not come
again within the window cannot match and are left out; in ordinary text that is
nearly all of them.

Every distance is a seed, extended in both directions as long as words repeat at that
distance. Seeds go by rising distance; one inside a stretch that is known with a period
that divides the distance would give the same stretch again and is left out. So the
period of a run is its least one.

Result of ``find``: the document's number of words, its runs in order (start, length, period in
words) and the text without repetitions: words that any run holds after its first
period are dropped, the others joined by one space.

Documents are independent of each other: no shuffle. A document is handled whole by
one task, in memory proportional to its length.

Defined cases: a null text has no words, no runs and an empty collapsed text;
repeated rows are handled each; an empty table gives an empty result; null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm import words as W

LEAST_WORDS = 24
EXPONENT = 3
SMALLEST = 8  # blocks of the first scale
PRIME = 998_244_353  # 119 * 2^23 + 1
ROOT = 3
CELLS = 1 << 18  # numbers in one batch of transforms
SLICE = 1 << 20

KIND = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, PRIME)) % np.uint64(PRIME)
        have += more
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number theoretic transform of every row (length a power of two); the result is in bit-reversed order."""
    p, (count, n) = np.uint64(PRIME), rows.shape
    width = n
    while width > 1:
        half = width // 2
        rows = rows.reshape(count, -1, width)
        low, high = rows[:, :, :half], rows[:, :, half:]
        turn = _powers(pow(ROOT, (PRIME - 1) // width, PRIME), half)
        rows = np.concatenate([(low + high) % p, (low + p - high) * turn % p], axis=2)
        width = half
    return rows.reshape(count, n)


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows whose transform (in bit-reversed order) is given."""
    p, (count, n) = np.uint64(PRIME), rows.shape
    width = 2
    while width <= n:
        half = width // 2
        rows = rows.reshape(count, -1, width)
        turn = _powers(pow(ROOT, PRIME - 1 - (PRIME - 1) // width, PRIME), half)
        low, high = rows[:, :, :half], rows[:, :, half:] * turn % p
        rows = np.concatenate([(low + high) % p, (low + p - high) % p], axis=2)
        width *= 2
    return rows.reshape(count, n) * np.uint64(pow(n, PRIME - 2, PRIME)) % p


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each block and each place in its window the sum of squared differences, modulo PRIME."""
    p, width = np.uint64(PRIME), blocks.shape[1]
    places = windows.shape[1] - width + 1
    n = 1 << (windows.shape[1] + width - 2).bit_length()
    padded = [np.zeros((len(blocks), n), dtype=np.uint64) for _ in range(2)]
    padded[0][:, :width] = blocks[:, ::-1] % p
    padded[1][:, : windows.shape[1]] = windows % p
    both = inverse(transform(padded[0]) * transform(padded[1]) % p)[:, width - 1 : width - 1 + places]
    squares = np.zeros((len(blocks), windows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(padded[1][:, : windows.shape[1]] ** 2 % p, axis=1, out=squares[:, 1:])  # below 2^63 for windows up to 2^33 words
    own = (padded[0] ** 2 % p).sum(axis=1, dtype=np.uint64)
    return (own[:, None] + (squares[:, width:] - squares[:, :-width]) % p + 2 * (p - both)) % p


def _seeds(word: np.ndarray, last: np.ndarray, at: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(distance, place) of every block at ``at`` that comes again after fewer than two widths; ``last`` ends a place's document."""
    nearest = 1 if width == SMALLEST else width
    reach = np.arange(nearest, 3 * width - 1)
    out = []
    for some in np.array_split(at, max(1, len(at) * 4 * width // CELLS)):
        if not len(some):
            continue
        window = some[:, None] + reach
        inside = window < last[some][:, None]
        blocks = word[some[:, None] + np.arange(width)]
        there = np.where(inside, word[np.minimum(window, len(word) - 1)], np.uint64(0))  # words are numbered from 1
        row, place = np.nonzero(mismatches(blocks, there) == 0)
        for r, d in zip(row.tolist(), (place + nearest).tolist(), strict=True):
            if np.array_equal(there[r, d - nearest : d - nearest + width], blocks[r]):
                out.append((d, int(some[r])))
    return sorted(out)


def _same(one: np.ndarray, two: np.ndarray) -> int:
    """How many words the arrays have in common at their beginning; looks at twice as many each time."""
    n, at, step = min(len(one), len(two)), 0, 64
    while at < n:
        differ = np.flatnonzero(one[at : at + step] != two[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


class _Stretches:
    """The stretches of one document that are known, whether long enough or not."""

    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end
        self.known = np.zeros((0, 3), dtype=np.int64)  # start, end, period

    def extend(self, word: np.ndarray, distance: int, place: int, width: int) -> None:
        known = self.known
        if ((known[:, 0] <= place) & (known[:, 1] >= place + width + distance) & (distance % known[:, 2] == 0)).any():
            return
        right = place + width + _same(word[place + width : self.end - distance], word[place + width + distance : self.end])
        back = word[self.begin : place][::-1], word[self.begin + distance : place + distance][::-1]
        self.known = np.vstack([known, [place - _same(*back), right + distance, distance]])

    def runs(self) -> list[tuple[int, int, int]]:
        least: dict[tuple[int, int], int] = {}
        for start, end, period in self.known.tolist():
            if end - start >= max(LEAST_WORDS, EXPONENT * period):
                least[start, end] = min(period, least.get((start, end), period))
        return sorted((start - self.begin, end - start, period) for (start, end), period in least.items())


def all_runs(word: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of every document that has one; document d is word[first[d]:first[d + 1]], words from 1."""
    n, doc = len(word), np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not n:
        return {}
    last = first[doc + 1]
    order = np.lexsort((np.arange(n), word, doc))
    again = np.full(n, n, dtype=np.int64)  # words until the same word comes again in its document
    equal = (word[order[1:]] == word[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    again[order[:-1][equal]] = (order[1:] - order[:-1])[equal]
    longest = int(np.diff(first).max())
    width = SMALLEST
    farthest = np.append(again, np.full(-n % width, n)).reshape(-1, width).max(axis=1)
    found: dict[int, _Stretches] = {}
    while width <= n and EXPONENT * width <= max(longest, EXPONENT * SMALLEST):
        at = np.flatnonzero(farthest < 2 * width) * width
        at = at[at + width <= last[at]]
        for distance, place in _seeds(word, last, at, width):
            d = int(doc[place])
            if d not in found:
                found[d] = _Stretches(int(first[d]), int(first[d + 1]))
            found[d].extend(word, distance, place, width)
        width *= 2
        farthest = np.append(farthest, np.full(len(farthest) % 2, n)).reshape(-1, 2).max(axis=1)
    return {d: runs for d, s in found.items() if (runs := s.runs())}


def finder(moved: Callable[[list, np.ndarray], np.ndarray] | None):
    """Arrow function: (id, text) to (id, n_words, runs, collapsed)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find_batches(batches):
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE):
                words = W.split(batch.column("text"), W.NON_SPACE)
                if moved is not None:
                    source = moved(batch.column("id").to_pylist(), words.first)
                    words = W.Words(words.buffer, words.start[source], words.end[source], words.first)
                size = words.end - words.start
                ends = np.concatenate([[0], np.cumsum(size)])
                flat = words.buffer[np.arange(int(ends[-1])) + np.repeat(words.start - ends[:-1], size)]
                texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(flat)).dictionary_encode()
                runs = all_runs(texts.indices.to_numpy().astype(np.uint64) + np.uint64(1), words.first)
                keep = np.ones(len(size), dtype=bool)
                for d, some in runs.items():
                    for start, length, period in some:
                        keep[words.first[d] + start + period : words.first[d] + start + length] = False
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(words.counts.astype(np.int64)),
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(d, [])]
                               for d in range(batch.num_rows)], type=kind),
                     _joined(flat, ends, keep, words.first)], names=["id", "n_words", "runs", "collapsed"])

    return find_batches


def _joined(flat: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    start, size = ends[:-1][keep], np.diff(ends)[keep]
    bounds = np.concatenate([[0], np.cumsum(keep)])[first]
    begins = np.zeros(len(size), dtype=bool)  # the first kept word of a document has no space before it
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    wide = size + ~begins
    stop = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(int(stop[-1]), 0x20, dtype=np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(stop[1:] - size - (np.cumsum(size) - size), size)] = flat[
        np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(stop[bounds]), pa.py_buffer(out)).cast(pa.string())


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         moved: Callable[[list, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row of ``docs``.

    ``moved(ids, first)`` may put other words of its document at a place: it returns the place that each
    of a slice's words is taken from, for documents with words first[d]:first[d + 1].
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        finder(moved), f"id {kind}, n_words bigint, runs {KIND}, collapsed string").withColumnRenamed("id", id_col)
