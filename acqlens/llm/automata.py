"""Weighted acyclic automata that count label paths.

A transducer reads a path of labels (a language, then words) and writes on every
arc how often the path up to there was counted. States with equal arcs (labels,
counts and targets) are one state, so endings that many paths share are kept once.
It is built incrementally from sorted paths: a block of paths that ends where the
first label changes is closed, and its states go through a register that holds
those of all blocks before. Arcs of a state are sorted by label, labels are in byte order.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

from acqlens.llm import words as W

DEPTH = 6  # a language and five words
PACKED_BITS = 21  # three labels in one sort key
BLOCK = 1 << 16  # paths of one block, if the first label lets it end there


def in_order(paths: np.ndarray) -> np.ndarray:
    """The order of label paths; -1 stands for no label and comes first."""
    if len(paths) and int(paths.max()) + 1 < 1 << PACKED_BITS:
        keys = packed(paths)
        return np.lexsort((keys[1], keys[0]))
    return np.lexsort(paths.T[::-1])


def packed(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sort keys of each path; labels must be below 2^PACKED_BITS - 1."""
    wide = (paths + 1).astype(np.uint64)
    shift = np.uint64(PACKED_BITS)
    return ((wide[:, 0] << shift | wide[:, 1]) << shift | wide[:, 2], (wide[:, 3] << shift | wide[:, 4]) << shift | wide[:, 5])


def summed(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paths in order and the sums of their counts."""
    if not len(paths):
        return paths, counts
    order = in_order(paths)
    paths, counts = paths[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], (paths[1:] != paths[:-1]).any(axis=1)]))
    return paths[start], np.add.reduceat(counts, start)


def prefixes(paths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the first rows of the prefixes of that many labels, and where the next prefix begins; paths are in order."""
    n = len(paths)
    changed, out = np.zeros(n, dtype=bool), []
    changed[:1] = True
    for depth in range(paths.shape[1]):
        changed[1:] |= paths[1:, depth] != paths[:-1, depth]
        start = np.flatnonzero(changed)
        stop = np.append(start[1:], n)
        there = paths[start, depth] >= 0
        out.append((start[there], stop[there]))
    return out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), then the same of first[1] and so on."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _planes(numbers: np.ndarray) -> tuple[int, int, bytes]:
    """Signed numbers as byte planes (all first bytes, then all second ones), which compress well; and how many of them."""
    low, high = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, len(numbers), numbers.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(width: int, n: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(-1).astype(np.int64)


class Transducer:
    """``texts`` of the labels; arcs first[s]:first[s + 1] of state s with label, count and target. State 0 has no arcs."""

    def __init__(self, texts: pa.Array, first: np.ndarray, label: np.ndarray, count: np.ndarray, target: np.ndarray, root: int):
        self.texts, self.first, self.label, self.count, self.target, self.root = texts, first, label, count, target, root

    def to_bytes(self) -> bytes:
        """States are numbered in the order of their paths, so differences of targets are small numbers."""
        texts = self.texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        text = (data or pa.py_buffer(b""))[int(ends[0]) : int(ends[-1])] if len(texts) else b""
        columns = [_planes(x) for x in (np.diff(ends), np.diff(self.first), self.label, self.count, np.diff(self.target, prepend=0))]
        body = pickle.dumps((bytes(text), self.root, columns), protocol=5)
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        size = int.from_bytes(data[:8], "little")
        text, root, columns = pickle.loads(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True))
        size, arcs, label, count, step = (_from_planes(*c) for c in columns)
        ends = np.concatenate([[0], np.cumsum(size)])
        texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(text))
        return cls(texts, np.concatenate([[0], np.cumsum(arcs)]), label, count, np.cumsum(step), root)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The paths that were added, and their counts (an arc's count less those of the arcs after it)."""
        size = np.diff(self.first)
        passed_on = np.concatenate([[0], np.cumsum(self.count)])
        passed_on = passed_on[self.first[1:]] - passed_on[self.first[:-1]]
        states, walked = np.array([self.root]), np.zeros((1, 0), dtype=np.int32)
        rows, counts = [], []
        while len(states):
            arcs = _ranges(self.first[states], size[states])
            walked = np.column_stack([np.repeat(walked, size[states], axis=0), self.label[arcs].astype(np.int32)])
            states = self.target[arcs]
            ends = self.count[arcs] - passed_on[states]
            here = ends > 0
            full = np.full((int(here.sum()), DEPTH), -1, dtype=np.int32)
            full[:, : walked.shape[1]] = walked[here]
            rows.append(full)
            counts.append(ends[here])
            on = size[states] > 0
            states, walked = states[on], walked[on]
        return np.concatenate(rows), np.concatenate(counts)

    def walk(self, paths: np.ndarray) -> np.ndarray:
        """Composition with an acceptor of ``paths`` (rows of labels): the count written after each label; 0 off the automaton."""
        keys = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * len(self.texts) + self.label
        state = np.full(len(paths), self.root, dtype=np.int64)
        out = np.zeros(paths.shape, dtype=np.int64)
        alive = np.ones(len(paths), dtype=bool)
        for depth in range(paths.shape[1]):
            wanted = state * len(self.texts) + paths[:, depth]
            arc = np.searchsorted(keys, wanted)
            alive &= (paths[:, depth] >= 0) & (arc < len(keys))
            alive[alive] = keys[arc[alive]] == wanted[alive]
            out[alive, depth] = self.count[arc[alive]]
            state[alive] = self.target[arc[alive]]
        return out


class Builder:
    """Adds sorted distinct label paths, block after block.

    With ``sums`` an arc counts all paths that go through it; else it has the count of the path that ends there.
    """

    def __init__(self, sums: bool = True):
        self.sums = sums
        self.register = [np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)]  # two marks, sorted; state
        self.states, self.arcs = 1, 0
        self.first, self.label, self.count, self.target = [np.array([0])], [], [], []
        self.roots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, paths: np.ndarray, counts: np.ndarray) -> None:
        at = 0
        ends = np.append(np.flatnonzero(paths[1:, 0] != paths[:-1, 0]) + 1, len(paths)) if len(paths) else []
        for end in ends:
            if end - at >= BLOCK or end == len(paths):
                self._close(paths[at:end], counts[at:end])
                at = end

    def _close(self, paths: np.ndarray, counts: np.ndarray) -> None:
        """States of a block of whole subtrees, from the leaves up."""
        nodes = prefixes(paths)
        total = np.concatenate([[0], np.cumsum(counts)])
        below: tuple | None = None  # first rows of the next level's nodes, and their labels, counts and states
        for depth in range(paths.shape[1] - 1, -1, -1):
            start, stop = nodes[depth]
            if self.sums:
                count = total[stop] - total[start]
            else:
                ends = np.ones(len(start), dtype=bool) if depth + 1 == paths.shape[1] else paths[start, depth + 1] < 0
                count = np.where(ends, counts[start], 0)
            states = np.zeros(len(start), dtype=np.int64)
            if below is not None and len(below[0]):
                low, high = np.searchsorted(below[0], start), np.searchsorted(below[0], stop)
                inner = np.flatnonzero(high > low)
                states[inner] = self._states(low[inner], high[inner] - low[inner], *below[1:])
            below = (start, paths[start, depth].astype(np.int64), count, states)
        self.roots.append(below[1:])

    def _states(self, low: np.ndarray, size: np.ndarray, label: np.ndarray, count: np.ndarray, target: np.ndarray) -> np.ndarray:
        """States with arcs low:low + size, each met before or new; equal ones are found by two marks of 64 bits.

        Marks only ever share states: if the first marks of different states were equal, an equal state may be kept twice.
        """
        marks = []
        for seed in (11, 12):
            a, b, c = W.stream(seed, 3)
            arc = W.mix(W.mix(W.mix(label.astype(np.uint64) ^ a) + count.astype(np.uint64) ^ b) + target.astype(np.uint64) ^ c)
            marks.append(W.mix(np.add.reduceat(arc[: low[-1] + size[-1]], low) + size.astype(np.uint64)))
        order = np.argsort(marks[0])
        one, two = marks[0][order], marks[1][order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        group = np.cumsum(new) - 1
        heads = np.minimum.reduceat(order, np.flatnonzero(new))  # the first in path order
        one, two = one[new], two[new]
        known, second, state = self.register
        at = np.minimum(np.searchsorted(known, one), max(len(known) - 1, 0))
        met = (known[at] == one) & (second[at] == two) if len(known) else np.zeros(len(one), dtype=bool)
        found = np.empty(len(heads), dtype=np.int64)
        found[met] = state[at[met]]
        fresh = np.flatnonzero(~met)
        fresh = fresh[np.argsort(heads[fresh])]
        found[fresh] = self.states + np.arange(len(fresh))
        self.states += len(fresh)
        arcs = _ranges(low[heads[fresh]], size[heads[fresh]])
        ends = self.arcs + np.cumsum(size[heads[fresh]])
        self.first.append(ends - size[heads[fresh]])
        self.label.append(label[arcs])
        self.count.append(count[arcs])
        self.target.append(target[arcs])
        self.arcs += len(arcs)
        merged = np.concatenate([known, one[~met]])
        sort = np.argsort(merged, kind="stable")
        self.register = [merged[sort], np.concatenate([second, two[~met]])[sort], np.concatenate([state, found[~met]])[sort]]
        out = np.empty(len(low), dtype=np.int64)
        out[order] = found[group]
        return out

    def finish(self, texts: pa.Array) -> Transducer:
        """The transducer; ``texts`` are the texts of all labels, of which it keeps those in use."""
        roots = [np.concatenate(x) for x in zip(*self.roots, strict=True)] if self.roots else [np.zeros(0, dtype=np.int64)] * 3
        first = np.concatenate([*self.first, [self.arcs, self.arcs + len(roots[0])]])
        label, count, target = (np.concatenate([*x, r]) for x, r in zip((self.label, self.count, self.target), roots, strict=True))
        used = np.unique(label)
        return Transducer(texts.take(pa.array(used)), first, np.searchsorted(used, label), count, target, self.states)
