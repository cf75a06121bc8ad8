"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification on whole documents.

A test item is a small set of five-word shingles, a document a large one, so
their Jaccard similarity says little; containment is estimated instead. Items are
partitioned by size (shingle counts from a power of two up to the next), and each
partition has a sketch setting of its own (``setting``): an item of q shingles is
contained with at least t if a document holds at least c = ceil(t q) of them, wherever
they stand, so it misses at most q - c. With a bottom-k MinHash sketch of the
k = q - c + h least shingle hashes it holds at least h of them. Partitions of larger
items ask for more hits h, so that one shingle that many items and many documents have
makes no candidate; no contained item is missed, whatever the partition.

Keys and shingles of the items go into two bitmaps sized by their counted number (at most 64 MB). Documents are
scanned once, map-side: a document with a key keeps those of its shingles that an
item may have. Equal sets (of documents, of items) are handled once, under a
64-bit mark. Candidate pairs are the (document, item) with the hits that the item's
partition asks for, counted after a join on the key; each pair's shingles are then counted by a join on (document's mark, shingle), so no row carries more than
one shingle and a long document with many items is spread over tasks.

Result: one row per (document, item) with the share of the item's distinct
shingles that the whole document holds, where that is at least the threshold.

Defined cases: null, empty and word-free texts hold nothing; items of fewer than
five words have no shingle and match nothing; repeated rows and ids give one row
per pair of ids with the greatest containment of a row (a null id is a value of
its own); extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acqlens.llm import words as W
from acqlens.llm.neardup import SHINGLE
from acqlens.llm.storage import bitmap, few, filter_bits, held, now_named, set_aside, settle

CONTAINMENT = 0.8


def setting(size: int, containment: float = CONTAINMENT) -> tuple[int, int]:
    """(k, h) of an item of ``size``: a document that contains it holds at least h of its k least shingle hashes.

    h is an eighth of the least size of the item's partition, and at least one.
    """
    least = math.ceil(containment * size)
    while least and (least - 1) / size >= containment:  # the quotient decides, as in the verification
        least -= 1
    while least / size < containment:
        least += 1
    hits = min(max(1, (1 << size.bit_length() - 1) >> 3), max(1, least))
    return min(size - least + hits, size), hits


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted shingle sets; texts of fewer than five words have none."""
    words = W.split(W.pc.utf8_lower(column), W.ALNUM)
    values, _, bounds = W.windows(words.keys(), words.first, SHINGLE, short=False)
    return [np.unique(values[bounds[d] : bounds[d + 1]]) for d in range(len(column))]


def _mark(shingles: np.ndarray) -> int:
    """One 64-bit key of a set."""
    return int(W.mix(np.array([W.mix(shingles * np.uint64(W.GOLDEN)).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def _rows(id_name: str, mark_name: str, ids: pa.Array, keys: list[np.ndarray], sets: list[np.ndarray], **more) -> pa.RecordBatch:
    lists = [pa.array([x.view(np.int64) for x in column], type=pa.list_(pa.int64())) for column in (keys, sets)]
    numbers = [pa.array(x, type=pa.int64()) for x in more.values()]
    return pa.RecordBatch.from_arrays([ids, pa.array([_mark(x) for x in sets], type=pa.int64()), *lists, *numbers],
                                      names=[id_name, mark_name, "keys", "shingles", *more])


def itemiser(containment: float):
    """Arrow function: (item, text) to (item, set, keys, shingles, hits); hits is what a candidate document needs."""

    def itemise(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                sets = _sets(batch.column("text"))
                rows = [d for d, s in enumerate(sets) if len(s)]
                sets = [sets[d] for d in rows]
                settings = [setting(len(s), containment) for s in sets]
                yield _rows("item", "item_set", batch.column("item").take(pa.array(rows, type=pa.int64())),
                            [s[:k] for s, (k, _) in zip(sets, settings, strict=True)], sets, hits=[h for _, h in settings])

    return itemise


def searcher(key_bits: np.ndarray, bits: np.ndarray):
    """Arrow function: (id, text) to (id, set, keys, shingles) of the documents with a key that an item may have."""

    def search(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                words = W.split(W.pc.utf8_lower(batch.column("text")), W.ALNUM)
                values, _, bounds = W.windows(words.keys(), words.first, SHINGLE, short=False)
                hits = np.flatnonzero(held(key_bits, values))
                rows = np.unique(np.searchsorted(bounds, hits, side="right") - 1)
                if not len(rows):
                    continue
                texts = [values[bounds[d] : bounds[d + 1]] for d in rows]
                yield _rows("id", "doc_set", batch.column("id").take(pa.array(rows, type=pa.int64())),
                            [np.unique(t[held(key_bits, t)]) for t in texts], [np.unique(t[held(bits, t)]) for t in texts])

    return search


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """(id, item id, containment) of every item found in a document; see the module text."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_id_col)))
    index = settle(items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).mapInArrow(
        itemiser(containment), f"item {item_kind}, item_set bigint, keys array<bigint>, shingles array<bigint>, hits bigint"))
    item_sets = index.dropDuplicates(["item_set"])
    keyed = item_sets.select("item_set", "hits", F.explode("keys").alias("key"))
    parts = item_sets.select("item_set", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    hits = settle(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        searcher(*(bitmap(x, c, filter_bits(x.count())) for x, c in ((keyed, "key"), (parts, "shingle")))),
        f"id {kind}, doc_set bigint, keys array<bigint>, shingles array<bigint>"))
    doc_sets = hits.dropDuplicates(["doc_set"])
    pairs = (doc_sets.select("doc_set", F.explode("keys").alias("key")).join(keyed, "key")
             .groupBy("doc_set", "item_set").agg(F.count(F.lit(1)).alias("met"), F.first("hits").alias("hits"))
             .where("met >= hits").select("doc_set", "item_set"))
    counted = (
        pairs.join(parts, "item_set")
        .join(doc_sets.select("doc_set", F.explode("shingles").alias("shingle")), ["doc_set", "shingle"])
        .groupBy("doc_set", "item_set").agg((F.count(F.lit(1)) / F.first("n")).alias("containment"))
        .where(F.col("containment") >= containment)
    )
    found = counted.join(hits.select("id", "doc_set"), "doc_set").join(index.select("item", "item_set"), "item_set")
    return found.groupBy("id", "item").agg(F.max("containment").alias("containment")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_id_col), "containment")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id has no leak (a null-safe anti join on the few leaking ids)."""
    bad = few(leaks(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("leaking")).distinct())
    docs, back = set_aside(docs, "leaking")
    return docs.join(bad, docs[now_named(back, id_col)].eqNullSafe(F.col("leaking")), "left_anti").withColumnsRenamed(back)
