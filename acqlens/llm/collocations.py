"""Phrase collocation mining with weighted acyclic automata.

1. One pass counts the words of every language. A word met less than ``least``
   times is in no candidate, so later passes take it as a gap; a bitmap sized by the
   counted frequent words tells which (a word too many does no harm).
2. Cells are ranges of label paths (language, words) in byte order. Their borders
   come from a sample of the words' places, so each cell has about as many places,
   also inside a very frequent word or pair; they have no effect on results.
3. Shards: a task sorts its paths of up to five words, sums equal ones and builds a
   count transducer from them (``automata.Builder``), one for each cell.
4. Union: the transducers of a cell are united, weights of equal paths summed, and
   the phrases (prefixes) with their sums returned. A cell returns what is frequent;
   prefixes that its borders cut it returns whatever their count, and those are
   summed over the cells.
5. Composition: the parts that the candidates of a cell need are looked up once a
   cell (a frequent part has one row per cell, not one per candidate), built into a
   transducer, and the candidates are composed with it: the counts of all their
   first parts and rests.
6. Scores are exact decimal arithmetic, a candidate inside a longer one that is as
   frequent goes, and the first ``top`` of each language stay.

Only phrases one word longer need be looked at when dropping: if a phrase lies in a
longer one that is frequent enough, so it does in every phrase between them.

Defined cases: null text is empty, a null language is ``und``; repeated rows count
each; an empty table, or one without a frequent phrase, gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acqlens.llm import words as W
from acqlens.llm.automata import DEPTH, Builder, Transducer, packed, prefixes, summed
from acqlens.llm.storage import bitmap, few, filter_bits, held, settle

LONGEST = DEPTH - 1  # words of a phrase
LEAST = 100
TOP = 2000
SCALE = 1000

# Bytes between pieces and bytes between words.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
BLANKS = b" \t"

SLICE = 1 << 21  # text bytes of one pass over arrays
SHARD_PATHS = 1 << 21  # distinct paths (or words) that a task holds before it gives a shard away
SHARD_WORDS = 1 << 20
CELL_PLACES = 1 << 19  # places of words in a cell
MAX_CELLS = 1 << 17  # bound of the list of borders that tasks get
SAMPLE = 1 << 11  # one place of so many is sampled for the borders
PER_CELL = 16  # sampled places a cell that the driver sorts

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IN_WORD = W.byte_table(drop=BREAKS + BLANKS)
IS_BREAK = ~W.byte_table(drop=BREAKS)


class Places:
    """The words of a slice: distinct texts, and for every place its word, document and the end of its piece."""

    def __init__(self, column: pa.Array):
        buffer, offsets = W.text_bytes(column)
        buffer = LOWER[buffer]
        words = W.split(column, IN_WORD)
        size = words.end - words.start
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = buffer[np.arange(int(ends[-1])) + np.repeat(words.start - ends[:-1], size)]
        texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(flat)).dictionary_encode()
        self.texts, self.word = texts.dictionary, texts.indices.to_numpy().astype(np.int64)
        self.doc = words.doc
        breaks = np.concatenate([[0], np.cumsum(IS_BREAK[buffer], dtype=np.int64)])
        self.piece = breaks[words.start] + self.doc  # grows from piece to piece and from document to document


def keys_of(words: pa.Array) -> np.ndarray:
    """64-bit keys of texts that are not empty."""
    data, ends = W.text_bytes(words)
    return W.Words(data, ends[:-1], ends[1:], np.array([0, len(words)])).keys()


def _keyed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch.column("word")).view(np.int64))], names=["key"])


def _languages(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.cast(pa.large_string()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def counter(batches):
    """Arrow function: (lang, text) to (lang, word, path, n): words counted, and a sample of places with the words after them."""
    kept: list[pa.Table] = []
    rows = 0
    names = ["lang", "word", "path", "n"]

    def added() -> pa.Table:
        return pa.concat_tables(kept).group_by(names[:3], use_threads=False).aggregate([("n", "sum")]).select(
            [*names[:3], "n_sum"]).rename_columns(names)

    for whole in batches:
        for batch in W.slices(whole, "text", SLICE):
            at = Places(batch.column("text"))
            langs, of_doc = _languages(batch.column("lang"))
            if not len(at.word):
                continue
            pairs, n = np.unique(of_doc[at.doc] * len(at.texts) + at.word, return_counts=True)
            word = pa.array(pairs % len(at.texts))
            kept.append(pa.table([langs.take(pa.array(pairs // len(at.texts))), at.texts.take(word), pa.nulls(len(n), pa.large_string()),
                                  pa.array(n.astype(np.int64))], names=names))
            place = np.arange(int(n.sum()) % SAMPLE, len(at.word), SAMPLE)
            path = [" ".join(at.texts.take(pa.array(at.word[p : p + LONGEST][at.piece[p : p + LONGEST] == at.piece[p]])).to_pylist())
                    for p in place]
            if path:
                kept.append(pa.table([langs.take(pa.array(of_doc[at.doc[place]])), pa.nulls(len(path), pa.large_string()),
                                      pa.array(path, type=pa.large_string()),
                                      pa.array(np.ones(len(path), dtype=np.int64))], names=names))
            rows += len(n)
            if rows > SHARD_PATHS // 2:
                kept = [added()]
                rows = kept[0].num_rows
                if rows > SHARD_PATHS // 4:
                    yield from kept[0].to_batches(1 << 16)
                    kept, rows = [], 0
    if kept:
        yield from added().to_batches(1 << 16)


def _ordered(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts in byte order and the new number of each."""
    order = pc.sort_indices(texts.cast(pa.large_binary())).to_numpy()
    place = np.empty(len(texts), dtype=np.int32)
    place[order] = np.arange(len(texts))
    return texts.take(pa.array(order)), place


def _array(texts) -> pa.Array:
    return pa.array(texts, type=pa.large_string())


def _cut(paths: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where each border's path would stand among sorted paths."""
    (high, low), (b_high, b_low) = packed(paths), packed(borders)
    first, last = np.searchsorted(high, b_high, "left"), np.searchsorted(high, b_high, "right")
    return np.array([a + np.searchsorted(low[a:b], x) for a, b, x in zip(first, last, b_low, strict=True)], dtype=np.int64)


def sharder(bits: np.ndarray, borders: list[tuple[str, ...]]):
    """Arrow function: (lang, text) to (cell, shard): a count transducer for every cell that a task's texts touch."""

    def give(texts: dict[str, int], paths: np.ndarray, counts: np.ndarray):
        for border in borders:
            for label in border:
                texts.setdefault(label, len(texts))
        labels, place = _ordered(_array(texts))
        paths, counts = summed(np.append(place, np.int32(-1))[paths], counts)  # -1 stays -1
        edges = np.array([[*(place[texts[x]] for x in b), *[-1] * (DEPTH - len(b))] for b in borders], dtype=np.int32).reshape(-1, DEPTH)
        cuts = np.concatenate([[0], _cut(paths, edges), [len(paths)]])
        for cell in np.flatnonzero(np.diff(cuts)):
            made = Builder()
            made.add(paths[cuts[cell] : cuts[cell + 1]], counts[cuts[cell] : cuts[cell + 1]])
            yield pa.RecordBatch.from_arrays([pa.array([cell], type=pa.int32()), pa.array([made.finish(labels).to_bytes()])],
                                             names=["cell", "shard"])

    def shard(batches):
        texts: dict[str, int] = {}
        paths, counts = [], []
        rows = 0
        for whole in batches:
            for batch in W.slices(whole, "text", SLICE):
                at = Places(batch.column("text"))
                if not len(at.word):
                    continue
                frequent = held(bits, keys_of(at.texts))
                number = np.full(len(frequent), -1, dtype=np.int32)
                for i, text in zip(np.flatnonzero(frequent), at.texts.filter(pa.array(frequent)).to_pylist(), strict=True):
                    number[i] = texts.setdefault(text, len(texts))
                langs, of_doc = _languages(batch.column("lang"))
                lang = np.array([texts.setdefault(x, len(texts)) for x in langs.to_pylist()], dtype=np.int32)
                word = number[at.word]
                n = len(word)
                made = np.full((n, DEPTH), -1, dtype=np.int32)
                made[:, 0] = lang[of_doc[at.doc]]
                on = np.ones(n, dtype=bool)
                for j in range(LONGEST):
                    m = max(n - j, 0)
                    on[m:] = False
                    on[:m] &= (word[j:] >= 0) & (at.piece[j:] == at.piece[:m])
                    made[:m, j + 1][on[:m]] = word[j:][on[:m]]
                made = made[made[:, 2] >= 0]
                got = summed(made, np.ones(len(made), dtype=np.int64))
                paths.append(got[0])
                counts.append(got[1])
                rows += len(got[0])
                if rows > SHARD_PATHS or len(texts) > SHARD_WORDS:
                    got = summed(np.concatenate(paths), np.concatenate(counts))
                    paths, counts, rows = [got[0]], [got[1]], len(got[0])
                    if rows > SHARD_PATHS // 2 or len(texts) > SHARD_WORDS:
                        yield from give(texts, *got)
                        texts, paths, counts, rows = {}, [], [], 0
        if rows:
            yield from give(texts, np.concatenate(paths), np.concatenate(counts))

    return shard


def uniter(least: int, borders: list[tuple[str, ...]]):
    """Grouped Arrow function: a cell's transducers to (lang, phrase, words, n, cell, cut)."""

    def unite(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        shards = [Transducer.from_bytes(data.as_py()) for data in table.column("shard")]
        every = pa.concat_arrays([s.texts for s in shards]).dictionary_encode()
        labels, place = _ordered(every.dictionary)
        number = place[every.indices.to_numpy()]
        paths, counts, rows, at = [], [], 0, 0
        for one in shards:
            path, count = one.paths()
            paths.append(np.append(number[at : at + len(one.texts)], np.int32(-1))[path])
            counts.append(count)
            at += len(one.texts)
            rows += len(count)
            if rows > SHARD_PATHS:  # holds the distinct paths of the cell, not all copies
                got = summed(np.concatenate(paths), np.concatenate(counts))
                paths, counts, rows = [got[0]], [got[1]], len(got[0]) // 2
        union, count = summed(np.concatenate(paths), np.concatenate(counts))
        total = np.concatenate([[0], np.cumsum(count)])
        near = borders[max(cell - 1, 0) : cell + 1]
        of = pc.index_in(_array([x for b in near for x in b]), labels).to_pylist() if near else []
        texts = {x: -2 if i is None else i for x, i in zip((x for b in near for x in b), of, strict=True)}
        edges = [[texts[x] for x in b] for b in near]
        out = []
        for depth, (start, stop) in enumerate(prefixes(union)):
            if depth < 2:  # words are counted already
                continue
            n = total[stop] - total[start]
            cut = np.zeros(len(n), dtype=bool)
            for edge in edges:
                if len(edge) > depth:
                    cut |= (union[start, : depth + 1] == np.array(edge[: depth + 1])).all(axis=1)
            take = (n >= least) | cut
            rows_ = union[start[take], : depth + 1]
            column = [labels.take(pa.array(rows_[:, j])) for j in range(depth + 1)]
            out.append(pa.table({"lang": column[0], "phrase": pc.binary_join_element_wise(*column[1:], pa.scalar(" ", type=pa.large_string())),
                                 "words": pa.array(np.full(len(rows_), depth, dtype=np.int32)), "n": n[take],
                                 "cell": pa.array(np.full(len(rows_), cell, dtype=np.int32)), "cut": cut[take]}))
        out = pa.concat_tables(out)
        return out.set_column(0, "lang", out["lang"].cast(pa.string())).set_column(1, "phrase", out["phrase"].cast(pa.string()))

    return unite


def composed(candidates: pa.Table, parts: pa.Table) -> pa.Table:
    """A cell's candidates and the parts they need, each as (cell, lang, phrase, n), to (lang, phrase, words, n, lefts, rights)."""
    texts: dict[str, int] = {}
    paths = []
    for table in (parts, candidates):
        path = np.full((table.num_rows, DEPTH), -1, dtype=np.int32)
        for i, (lang, phrase) in enumerate(zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True)):
            for j, label in enumerate([lang, *phrase.split(" ")]):
                path[i, j] = texts.setdefault(label, len(texts))
        paths.append(path)
    labels, place = _ordered(_array(texts))
    paths = [np.append(place, np.int32(-1))[p] for p in paths]
    made = Builder(sums=False)
    made.add(*summed(paths[0], parts.column(3).to_numpy()))
    counts = made.finish(labels)
    # The transducer numbers the labels of the parts anew; other labels are on none of its arcs.
    number = np.append(pc.fill_null(pc.index_in(labels, counts.texts), -1).to_numpy(), -1).astype(np.int64)
    wanted = number[paths[1]]
    size = (paths[1][:, 1:] >= 0).sum(axis=1)
    lefts = counts.walk(wanted)[:, 1:]
    rights = np.zeros_like(lefts)
    for k in range(1, LONGEST):
        rest = np.column_stack([wanted[:, :1], wanted[:, k + 1 :]])
        written = counts.walk(rest)
        some = size > k
        rights[some, k - 1] = written[some, size[some] - k]
    ends = np.concatenate([[0], np.cumsum(np.maximum(size - 1, 0))])
    inside = np.arange(LONGEST)[None, :] < (size - 1)[:, None]
    return pa.table({"lang": candidates.column("lang"), "phrase": candidates.column("phrase"), "words": pa.array(size.astype(np.int32)),
                     "n": candidates.column("n"),
                     **{c: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x[inside]))
                        for c, x in (("lefts", lefts), ("rights", rights))}})


def _borders(sample: DataFrame, places: int) -> list[tuple[str, ...]]:
    """Borders of the cells: paths at even steps of a sample of bounded size."""
    cells = min(MAX_CELLS, max(1, math.ceil(places / CELL_PLACES)))
    known = sample.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    share = min(1.0, PER_CELL * cells / max(known, 1))
    if share < 1:
        sample = sample.sample(share, seed=0)
    rows = sorted([r.lang.encode(), *(w.encode() for w in r.path.split(" "))] for r in sample.select("lang", "path").collect())
    picked = [rows[i * len(rows) // cells] for i in range(1, cells)] if rows else []
    return [tuple(x.decode() for x in b) for b in sorted({tuple(p) for p in picked})]


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n, lefts, rights) of all phrases of 2 to 5 words met ``least`` times or more, and (lang, total words).

    lefts and rights are the counts of the phrase's first k words and of the rest, for every k.
    """
    source = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted = settle(source.mapInArrow(counter, "lang string, word string, path string, n bigint")
                     .groupBy("lang", "word", "path").agg(F.sum("n").alias("n")))
    words = counted.where("word is not null")
    totals = few(words.groupBy("lang").agg(F.sum("n").alias("total")))  # few languages are broadcast: candidates are not dealt by language
    frequent = words.where(F.col("n") >= least)
    borders = _borders(counted.where("path is not null"), totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first().n)
    bits = bitmap(frequent.select("word").mapInArrow(_keyed, "key bigint"), "key", filter_bits(frequent.count()))
    united = (source.mapInArrow(sharder(bits, borders), "cell int, shard binary")
              .groupBy("cell").applyInArrow(uniter(least, borders), "lang string, phrase string, words int, n bigint, cell int, cut boolean"))
    united = settle(united)
    whole = united.where("not cut").select("lang", "phrase", "words", "n", "cell")
    cut = united.where("cut").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), F.min("cell").alias("cell"))
    grams = settle(whole.unionByName(cut.where(F.col("n") >= least)))

    parted = grams.withColumn("w", F.split("phrase", " ", -1))
    parts = parted.select("cell", "lang", F.explode(F.expr("""
        flatten(transform(sequence(1, words - 1), k -> array(array_join(slice(w, 1, k), ' '), array_join(slice(w, k + 1, words - k), ' '))))
        """)).alias("phrase")).distinct()
    known = frequent.select("lang", F.col("word").alias("phrase"), "n").union(grams.select("lang", "phrase", "n"))
    looked_up = parts.join(known, ["lang", "phrase"]).select("cell", "lang", "phrase", "n").toDF("at", "part_lang", "part", "times")
    found = grams.select("cell", "lang", "phrase", "n").groupBy("cell").cogroup(looked_up.groupBy("at")).applyInArrow(
        composed, "lang string, phrase string, words int, n bigint, lefts array<bigint>, rights array<bigint>")
    return settle(found), totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases; see the module text."""
    found, totals = phrases(docs, lang_col, text_col, least)
    inner = found.where("words > 2").select("lang", "n", F.split("phrase", " ", -1).alias("w"), "words", "lefts", "rights").select(
        "lang", "n", F.inline(F.expr("""array(struct(array_join(slice(w, 1, words - 1), ' ') as phrase, lefts[words - 2] as part),
                                              struct(array_join(slice(w, 2, words - 1), ' ') as phrase, rights[0] as part))""")))
    dropped = inner.where("n >= part").select("lang", "phrase").distinct()
    best = F.expr(f"""
        array_min(transform(sequence(1, words - 1), k -> struct(
          (cast(cast(n as decimal(19, 0)) * {SCALE} as decimal(22, 0)) * cast(total as decimal(16, 0)))
            div (cast(lefts[k - 1] as decimal(19, 0)) * cast(rights[k - 1] as decimal(19, 0))) as score, k as k)))""")
    scored = found.join(dropped, ["lang", "phrase"], "left_anti").join(totals, "lang").withColumn("best", best).select(
        "lang", "phrase", F.col("n").alias("a"), F.expr("lefts[best.k - 1]").alias("l"), F.expr("rights[best.k - 1]").alias("r"),
        F.col("total").alias("n"), F.col("best.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
