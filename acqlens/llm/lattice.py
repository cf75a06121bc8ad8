"""Subword lattice scoring: the marginal probability of a text over all its segmentations.

The pieces come from an existing vocabulary file; its scores (ranks) give piece
probabilities, which are the start and the prior (one pseudo-count per piece on average,
dealt by the scores) of expectation-maximisation on the distinct training words. Pieces do not cross word borders, so a text's marginal
probability is the product of its words' and of the end token's.

A word's lattice has one more edge, from its start to its end: the word as a
whole, if the training documents hold it. Its count c gives that edge (c - D) / N,
and the discount D taken from each of the T distinct words is the probability
D T / N of spelling a word from pieces, so a word has

    max(c - D, 0) / N + D T / N * (forward recursion over its pieces, in log space)

and all words together at most 1. D comes from the numbers of words seen once and
twice. Every spelling has a probability, and frequent words have their own.

The corpus is gathered once as a word table: (word, training count, count), one
row per distinct word, so it grows with the input. E-steps, piece counts and the
forward recursion run over that table, partitioned, not over the texts; only the
expected count of each vocabulary piece (a fixed number) reaches the driver.
Scoring joins each document's words with the table. The FREQUENT most frequent
words (a fixed number, hence a bounded broadcast) are looked up map-side, which
also takes the hot keys out of the join (they are found by a histogram); every other word goes through the
shuffle join, so nothing is cut.

Defined cases: null text is empty: one token, the end. A character without piece
costs one fallback byte per UTF-8 byte, so every text has a probability. Repeated
rows are scored each. Without training documents all counts are zero and pieces
alone give the score. Extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
import types
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acqlens.llm import words as W
from acqlens.llm.storage import settle

FREQUENT = 100_000
WORDS_AT_ONCE = 100_000  # distinct words handled together by the vectorised recursions
DISTINCT_HELD = 300_000  # distinct words a task counts before it hands its counts on
ROUNDS = 2
SPACE = "▁"  # fixed value: the vocabulary's word-start mark
END = "</s>"
LONG = 96  # longer words take the scalar recursion
LOWER = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b"     ")


class Vocabulary:
    """Pieces (usable ones, without control and byte pieces), starting log probabilities, and lookups by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                                                 or model.is_unused(i))]
        usable = [i for i in usable if SPACE not in model.id_to_piece(i)[1:]]
        self.pieces = [model.id_to_piece(i) for i in usable]
        rank = -np.array([model.get_score(i) for i in usable])
        weight = 1 / (np.maximum(rank, 0) + 10)  # the scores are ranks: a Zipf start
        self.n = len(self.pieces)  # two more parameters follow: fallback byte, end
        self.start = np.log(np.concatenate([weight / weight.sum() * 0.98, [0.01, 0.01]]))
        self.index = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        keys = np.zeros(self.n, dtype=np.uint64)
        for j in range(self.longest):
            codes = np.array([ord(p[j]) if j < len(p) else 0 for p in self.pieces], dtype=np.uint64)
            keys = np.where(codes > 0, _extend(keys, codes), keys)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.door = np.zeros(1 << 20, dtype=bool)
        self.door[(W.mix(self.keys) >> np.uint64(44)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece numbers of substring keys, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        may = np.flatnonzero(self.door[(W.mix(keys) >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[may]), self.n - 1)
        out[may] = np.where(self.keys[at] == keys[may], self.ids[at], -1)
        return out


def _extend(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (keys ^ codes) * W.STEP + np.uint64(W.GOLDEN)


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary: one per Python process, kept between its tasks."""
    kept = sys.modules.setdefault("_acqlens_worker_state", types.ModuleType("_acqlens_worker_state")).__dict__
    if ("vocabulary", path) not in kept:
        kept[("vocabulary", path)] = Vocabulary(path)
    return kept[("vocabulary", path)]


def _lattice(words: list[str], vocab: Vocabulary):
    """Edges of equally long words: yields (from, to, piece of each word or -1, fallback bytes of each word)."""
    length = len(words[0])
    codes = np.array([np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype="<u4") for w in words]).astype(np.uint64)
    size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
    for i in range(length):
        keys = np.zeros(len(words), dtype=np.uint64)
        for j in range(i, min(length, i + vocab.longest)):
            keys = _extend(keys, codes[:, j])
            yield i, j + 1, vocab.find(keys), size[:, j] if j == i else None


def _edge(logp: np.ndarray, piece: np.ndarray, fallback, n: int) -> np.ndarray:
    weight = np.where(piece >= 0, logp[piece], -np.inf)
    if fallback is not None:
        weight = np.where(piece >= 0, weight, fallback * (logp[n] - math.log(256)))
    return weight


def forward(words: list[str], logp: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Natural-log marginal probability of each word (words of one length)."""
    if len(words[0]) > LONG:
        return np.array([_forward_one(w, logp, vocab) for w in words])
    alpha = np.full((len(words[0]) + 1, len(words)), -np.inf)
    alpha[0] = 0
    for i, j, piece, fallback in _lattice(words, vocab):
        if fallback is not None or (piece >= 0).any():
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + _edge(logp, piece, fallback, vocab.n))
    return alpha[-1]


def _edges_one(word: str, logp: np.ndarray, vocab: Vocabulary):
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + vocab.longest) + 1):
            k = vocab.index.get(word[i:j])
            if k is not None:
                yield i, j, k, logp[k]
            elif j == i + 1:
                n = len(word[i].encode("utf-8", "surrogatepass"))
                yield i, j, -n, n * (logp[vocab.n] - math.log(256))


def _forward_one(word: str, logp: np.ndarray, vocab: Vocabulary) -> float:
    alpha = [0.0] + [-math.inf] * len(word)
    for i, j, _, w in _edges_one(word, logp, vocab):
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + w)
    return float(alpha[-1])


def expected(words: list[str], weight: np.ndarray, logp: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Expected piece counts (forward-backward) of words of one length, each taken ``weight`` times."""
    total = np.zeros(vocab.n + 2)
    length = len(words[0])
    if length > LONG:
        for w, times in zip(words, weight, strict=True):
            edges = list(_edges_one(w, logp, vocab))
            alpha, beta = [0.0] + [-math.inf] * length, [-math.inf] * length + [0.0]
            for i, j, _, x in edges:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + x)
            for i, j, _, x in reversed(edges):
                beta[i] = np.logaddexp(beta[i], beta[j] + x)
            for i, j, k, x in edges:
                p = math.exp(alpha[i] + x + beta[j] - alpha[-1]) * times
                total[k if k >= 0 else vocab.n] += p * (1 if k >= 0 else -k)
        return total
    edges = []
    alpha = np.full((length + 1, len(words)), -np.inf)
    beta = np.full((length + 1, len(words)), -np.inf)
    alpha[0] = beta[length] = 0
    for i, j, piece, fallback in _lattice(words, vocab):
        if fallback is not None or (piece >= 0).any():
            x = _edge(logp, piece, fallback, vocab.n)
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + x)
            edges.append((i, j, piece, fallback, x))
    for i, j, piece, fallback, x in reversed(edges):
        share = np.exp(alpha[i] + x + beta[j] - alpha[length]) * weight
        there = piece >= 0
        total[: vocab.n] += np.bincount(piece[there], weights=share[there], minlength=vocab.n)
        if fallback is not None:
            total[vocab.n] += float((share * fallback)[~there].sum())
        beta[i] = np.logaddexp(beta[i], beta[j] + x)
    return total


def _by_length(words: list[str]):
    """Groups of row numbers whose marked words have one length, of bounded total size."""
    size = np.array([len(w) for w in words]) + 1
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, (1 << 18) // int(size[group[0]]))
        for at in range(0, len(group), step):
            yield group[at : at + step]


def _tokens(column: pa.Array) -> list[list[str]]:
    """The words of each text, A-Z lower-cased; cut at ASCII white space only."""
    return [[w for w in (t or "").encode().translate(LOWER).decode().split(" ") if w] for t in column.to_pylist()]


def _count_words(batches):
    """(word, known, n): counts of training words and of all words, summed per slice of the task."""
    train, other = Counter(), Counter()

    def flush():
        n = other.copy()
        n.update(train)
        words = list(n)
        out = pa.RecordBatch.from_arrays(
            [pa.array(words, type=pa.string()), pa.array([train[w] for w in words], type=pa.int64()),
             pa.array(list(n.values()), type=pa.int64())], names=["word", "c", "n"])
        train.clear()
        other.clear()
        return out

    for whole in batches:
        for batch in W.slices(whole, "text"):
            for words, use in zip(_tokens(batch.column("text")), batch.column("train").to_pylist(), strict=True):
                (train if use else other).update(words)
            if len(train) + len(other) > DISTINCT_HELD:
                yield flush()
    if train or other:
        yield flush()


def word_table(docs: DataFrame) -> DataFrame:
    """(word, c, n) of a frame (text, train): training count and count of every distinct word."""
    return docs.mapInArrow(_count_words, "word string, c bigint, n bigint").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))


def _together(batches):
    """Record batches joined to about WORDS_AT_ONCE rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= WORDS_AT_ONCE:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _expected_pieces(path: str, logp: np.ndarray):
    def run(batches):
        vocab = vocabulary(path)
        total = np.zeros(vocab.n + 2)
        for batch in _together(batches):
            words = batch.column("word").to_pylist()
            for rows in _by_length(words):
                total += expected([SPACE + words[r] for r in rows], np.ones(len(rows)), logp, vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int64()), pa.array(total[used])], names=["piece", "n"])

    return run


def fit(words: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Natural-log probabilities of the pieces, the fallback byte and the end, by EM over the word table.

    Each distinct training word counts once, as each gives one discount to the pieces. The
    vocabulary's scores are the prior: pseudo-counts, on average one per piece.
    """
    vocab = vocabulary(path)
    logp = vocab.start
    seen = words.where("c > 0").select("word")
    for _ in range(rounds):
        rows = seen.mapInArrow(_expected_pieces(path, logp), "piece bigint, n double").groupBy("piece").agg(
            F.sum("n").alias("n")).collect()  # one row per vocabulary piece at most
        n = (vocab.n + 2) * np.exp(vocab.start)
        n[vocab.n + 1] += 1
        for r in rows:
            n[r.piece] += r.n
        logp = np.log(n / n.sum())
    return logp


@dataclass(frozen=True)
class WholeWords:
    """What whole-word edges take from a word table: all counts N, the discount D, the share of pieces D T / N."""

    total: int
    discount: float
    pieces: float

    @staticmethod
    def of(total: int, distinct: int, once: int, twice: int) -> WholeWords:
        discount = (once + 1) / (once + 2 * twice + 2)
        return WholeWords(total, discount, discount * distinct / total if total else 1.0)

    def mixed(self, count: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """log10 probability of tokens with these training counts and natural-log piece probabilities."""
        own = np.maximum(count - self.discount, 0) / max(self.total, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(own), math.log(self.pieces) + spelt) / math.log(10)


def _score_words(path: str, logp: np.ndarray, whole: WholeWords):
    """Arrow function: (word, c, n) with the log10 marginal probability of each word."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in _together(batches):
            words = batch.column("word").to_pylist()
            out = np.zeros(len(words))
            for rows in _by_length(words):
                out[rows] = forward([SPACE + words[r] for r in rows], logp, vocab)
            score = whole.mixed(batch.column("c").to_numpy(), out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=["word", "c", "n", "word_score"])

    return run


def _frequent(words: DataFrame) -> dict[str, tuple[int, float, float]]:
    """The most frequent words, at most FREQUENT: all with a count of at least a bound.

    The bound comes from a histogram over sixteenths of powers of two (at most
    1,024 rows), so no task or driver sorts the table.
    """
    level = F.floor(F.log2("n") * 16)
    sizes = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size")).collect(), reverse=True)
    least, total = None, 0
    for row in sizes:
        total += row["size"]
        if total > FREQUENT:
            break
        least = row["level"]
    if least is None:
        return {}
    rows = words.where(level >= least).select("word", (F.col("c") > 0).cast("int").alias("known"), "base", "word_score").collect()
    return {r.word: (r.known, r.base, r.word_score) for r in rows}


def _document_words(frequent):
    """Arrow function: (row, id, held_out, text) to one head row per document and one per rarer word.

    A head row carries the id and the sums over frequent words; its key begins
    with a space, so it meets no word and no two heads share a key.
    """

    def run(batches):
        table = frequent.value
        for whole in batches:
            for batch in W.slices(whole, "text"):
                row, key, times, tokens, known, base, score, head = ([] for _ in range(8))
                ids = batch.column("row").to_pylist()
                for at, (r, words) in enumerate(zip(ids, _tokens(batch.column("text")), strict=True)):
                    rare = Counter()
                    k, b, s = 0, 0.0, 0.0
                    for w, n in Counter(words).items():
                        hit = table.get(w)
                        if hit is None:
                            rare[w] = n
                        else:
                            k += n * hit[0]
                            b += n * hit[1]
                            s += n * hit[2]
                    row.append(r), key.append(f" {r}"), times.append(0), tokens.append(len(words) + 1)
                    known.append(k), base.append(b), score.append(s)
                    m = len(rare)
                    head += [at] + [None] * m
                    row += [r] * m
                    key += rare
                    times += rare.values()
                    tokens += [0] * m
                    known += [0] * m
                    base += [0.0] * m
                    score += [0.0] * m
                at = pa.array(head, type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("held_out").take(at),
                     pa.array(row, type=pa.int64()), pa.array(key, type=pa.string()), pa.array(times, type=pa.int64()),
                     pa.array(tokens, type=pa.int64()), pa.array(known, type=pa.int64()),
                     pa.array(base, type=pa.float64()), pa.array(score, type=pa.float64())],
                    names=["id", "held_out", "row", "word", "times", "tokens", "known", "base", "score"])

    return run


def scored(docs: DataFrame, path: str, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
           rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``held_out`` is a deterministic condition on columns of ``docs``; rows where it
    is true are scored but not learnt from. ``docs`` is read more than once and
    must give the same rows each time (a table or a checkpoint).
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    counted = settle(word_table(source.select("text", (~F.col("held_out")).alias("train"))))
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v"),
                       F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")).first()
    train_docs = source.where(~F.col("held_out")).count()
    total, distinct = sums.c + train_docs, sums.v + (train_docs > 0)
    logp = fit(counted, path, rounds)
    whole = WholeWords.of(total, distinct, sums.once, sums.twice)
    bottom = math.log10(total + distinct + 1)
    words = settle(counted.mapInArrow(_score_words(path, logp, whole), "word string, c bigint, n bigint, word_score double")
                   .withColumn("base", F.log10(F.col("c") + 1) - bottom))
    frequent = spark.sparkContext.broadcast(_frequent(words))

    kind = docs.schema[id_col].dataType.simpleString()
    parts = source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _document_words(frequent), f"id {kind}, held_out boolean, row bigint, word string, times bigint, "
        "tokens bigint, known bigint, base double, score double")
    table = words.select("word", (F.col("c") > 0).cast("bigint").alias("w_known"), F.col("base").alias("w_base"),
                         F.col("word_score").alias("w_score"))
    times = F.col("times")
    end_known = 1 if train_docs else 0
    end_base = math.log10(train_docs + 1) - bottom
    end_score = float(whole.mixed(np.array([train_docs]), logp[-1:])[0])
    return parts.join(table, "word", "left").groupBy("row").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.sum("tokens").alias("n_tokens"),
        (F.sum(F.col("known") + F.coalesce(times * F.col("w_known"), F.lit(0))) + end_known).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.sum(F.col("base") + F.coalesce(times * F.col("w_base"), F.lit(0.0))) + end_base).alias("base_score"),
        (F.sum(F.col("score") + F.coalesce(times * F.col("w_score"), F.lit(0.0))) + end_score).alias("score")).drop("row")
