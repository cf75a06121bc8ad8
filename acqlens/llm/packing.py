"""Packing into fixed windows by minimum bin slack.

Every task tokenises its documents and cuts each into full windows and one
remainder. Remainders wait in a pool, counted by length. A window opens with the
longest waiting piece; a subset-sum dynamic programme over the multiset of
waiting lengths (one bit per reachable sum, counts split into powers of two)
finds the sum closest to the free space, and the lengths and counts that make it
are read back from the programme's steps. When the pool is smaller than a low
mark, more documents are read first; after the last document the pool is packed
out, cutting a waiting piece where a window would stay short, and a last
incomplete window is cut at powers of two, which need no padding.

There is no shuffle, and a task holds at most the pool (POOL pieces of less than
a window) and one slice of documents. Sequence ids are the task's partition
number and a counter, so a task that runs again writes the same rows.

Defined cases: a null or empty text is one piece with only the end id; repeated
rows are packed each; an empty table gives an empty result; null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from acqlens.llm import words as W

WINDOW = 2048
END_ID = 1
POOL = 8192  # remainders that wait at most
LOW = 4096  # windows are filled until this many wait
SLACK = 8  # a window that stays shorter by more than this takes a cut piece
CACHE = 200_000  # word pieces in each of the worker's two cache generations (about 40 MB each)
TOGETHER = 128  # fresh word pieces encoded in one call

# The vocabulary's word pattern for lower-cased Latin-1 text without control characters.
PLAIN = re.compile("[^\\t\\n\\r -~\\xa1-\\xff]")
PIECE = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff]+|[0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]"
                   "|[^\\sa-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]+")


class Encoder:
    """Token ids of texts; ids of repeated words are remembered up to a bound.

    The vocabulary merges inside words only, so the ids of a text are those of
    its words in order. Texts with other characters than Latin-1, and those that
    hold what a special token begins with, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = sorted({*map(str.lower, special), *map(str.upper, special)})  # how a special token begins
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        vocab = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocab.values()) + 1, dtype=bool)  # tokens that end a word piece
        self.final[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before: pieces met again move back

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of single word pieces: many in one text, cut at the tokens that end a piece."""
        out: list[bytes] = []
        groups = [pieces[at : at + TOGETHER] for at in range(0, len(pieces), TOGETHER)]
        for group, raw in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ends = (np.flatnonzero(self.final[np.frombuffer(raw, dtype=self.kind)]) + 1) * self.kind.itemsize
            cuts = [0, *ends.tolist()]
            whole = len(ends) == len(group) and cuts[-1] == len(raw)
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])] if whole else self._encode(group)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [None if PLAIN.search(t) or any(s in t for s in self.special) else PIECE.findall(t.lower()) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        absent = set().union(*filter(None, split)).difference(known)
        known.update((w, old[w]) for w in absent if w in old)
        fresh = [w for w in absent if w not in known]
        known.update(zip(fresh, self._encode_pieces(fresh), strict=True))
        rest = iter(self._encode([t for t, words in zip(texts, split, strict=True) if words is None]))
        return [np.frombuffer(next(rest) if words is None else b"".join(map(known.__getitem__, words)), dtype=self.kind)
                for words in split]


def encoder(path: str) -> Encoder:
    """The worker's encoder: one per Python process, kept between its tasks."""
    kept = sys.modules.setdefault("_acqlens_worker_state", types.ModuleType("_acqlens_worker_state")).__dict__
    if ("encoder", path) not in kept:
        kept[("encoder", path)] = Encoder(path)
    return kept[("encoder", path)]


def closest(waiting: dict[int, deque], present: int, space: int) -> dict[int, int]:
    """How many pieces of each length fill ``space`` best.

    ``present`` has a bit for each length that waits; lengths are taken longest
    first, until the whole space is reachable.
    """
    full = (1 << (space + 1)) - 1
    goal, reach, steps = 1 << space, 1, []
    present &= full
    while present and not reach & goal:
        length = present.bit_length() - 1
        present ^= 1 << length
        count, part = min(len(waiting[length]), space // length), 1
        while count and not reach & goal:
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & full
            count -= part
            part *= 2
    at = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            chosen[length] += part
    return chosen


class Pool:
    """Waiting pieces by length; ``fill`` takes out one window's pieces."""

    def __init__(self, window: int):
        self.window, self.size, self.present = window, 0, 0
        self.by: dict[int, deque] = defaultdict(deque)

    def add(self, piece) -> None:
        length = len(piece[2])
        self.by[length].append(piece)
        self.present |= 1 << length
        self.size += 1

    def take(self, length: int):
        line = self.by[length]
        piece = line.popleft()
        self.size -= 1
        if not line:
            self.present ^= 1 << length
        return piece

    def fill(self) -> list:
        longest = self.present.bit_length() - 1
        out = [self.take(longest)]
        space = self.window - longest
        for length, n in closest(self.by, self.present, space).items():
            out += [self.take(length) for _ in range(n)]
            space -= n * length
        if space > SLACK and self.size:  # every waiting piece is longer than the space
            doc, start, ids, total = self.take(min(length for length, line in self.by.items() if line))
            out.append((doc, start, ids[:space], total))
            self.add((doc, start + space, ids[space:], total))
        return out


def _powers(pieces: list) -> list[list]:
    """An incomplete window's pieces, cut into windows whose sizes are powers of two."""
    left, out = sum(len(p[2]) for p in pieces), []
    line = deque(pieces)
    while left:
        want = 1 << (left.bit_length() - 1)
        left -= want
        out.append([])
        while want:
            doc, start, ids, total = line.popleft()
            out[-1].append((doc, start, ids[:want], total))
            if len(ids) > want:
                line.appendleft((doc, start + want, ids[want:], total))
            want -= min(want, len(ids))
    return out


def windows(documents, window: int = WINDOW):
    """Windows (lists of (id, start, ids, document tokens)) of an iterator of (id, ids)."""
    pool = Pool(window)
    for doc, ids in documents:
        total = len(ids)
        whole = total - total % window
        for start in range(0, whole, window):
            yield [(doc, start, ids[start : start + window], total)]
        if whole < total:
            pool.add((doc, whole, ids[whole:], total))
        if pool.size > POOL:
            while pool.size > LOW:
                yield pool.fill()
    while pool.size:
        pieces = pool.fill()
        if pool.size or sum(len(p[2]) for p in pieces) == window:
            yield pieces
        else:
            yield from _powers(pieces)


def packer(path: str, window: int, with_ids: bool, id_type: pa.DataType):
    """Arrow function: (id, text) to the pieces of this task's sequences."""
    fields = [("id", id_type), *((c, pa.int64()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def documents(batches):
        coder = encoder(path)
        end = np.array([END_ID], dtype=coder.kind)
        for whole in batches:
            for batch in W.slices(whole, "text"):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for doc, ids in zip(batch.column("id").to_pylist(), coder.encode(texts), strict=True):
                    yield doc, np.concatenate([ids, end])

    def pack_batches(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for number, pieces in enumerate(windows(documents(batches), window)):
            offset = 0
            for doc, start, ids, total in pieces:
                wide = ids.astype("<u4")
                row = (doc, start, len(ids), zlib.crc32(wide), total, base + number, offset)
                rows.append((*row, wide.astype(np.int32)) if with_ids else row)
                offset += len(ids)
            if len(rows) >= 2000:
                yield flush()
                rows.clear()
        if rows:
            yield flush()

    return pack_batches


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids themselves."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else ""))
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        packer(tokenizer_path, window, with_ids, to_arrow_type(docs.schema[id_col].dataType)), schema).withColumnRenamed("id", id_col)
