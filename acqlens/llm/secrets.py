"""Secret scan: pattern rules, and character Markov models of random strings and identifiers.

Base rules find credentials by their form. Two first-order character models are
trained on the whole corpus from labelled samples: transitions inside the values that
the rules find (random strings), and inside ordinary text and identifiers: all other
runs of the alphabet, and every two neighbouring words of the corpus written as snake,
kebab, camel and capital-snake identifiers, some with a version. Both models fall back
to classes of characters (small, capital, digit, each sign), so that a pair of letters
that the corpus does not have is no sign of randomness. Training is one pass that counts
transitions per task (a fixed alphabet, so at most 2 x 66^2 rows per task) and
sums them in Spark. What the base spans leave of a run of the alphabet is a secret
too, if it has at least MIN_RUN characters and its log-likelihood ratio is high per
character and in total; nothing else decides.

Spans are code points, end exclusive; kinds are assign, access, hex and random.

Defined cases: null text is empty and has no span; repeated rows are scanned each;
without any labelled value the random model is uniform; extra columns are kept
by ``redacted`` and ignored by ``scan``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.llm import words as W
from acqlens.llm.storage import now_named, set_aside

# The base rules.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
BACKOFF = 0.3  # share of the class model in both models
VERSIONED = 20  # one identifier of so many ends in a version
LEAST = {"assign": 6, "access": 20, "hex": 24}

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 1  # 0 stands for any other character
MIN_RUN = 16
PER_CHARACTER = 0.35  # least log-likelihood ratio (natural log) per transition
IN_TOTAL = 7.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
MASK = "[secret]"

CODE = np.zeros(256, dtype=np.int64)
CODE[np.frombuffer(ALPHABET, dtype=np.uint8)] = np.arange(1, SYMBOLS)
IN_RUN = CODE > 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's place, kind, end), in order; the start of the value is not part of the result."""
    return [(a, KINDS.index(kind), kind, b) for a, b, kind, _, _ in _base(text)]


def _base(text: str) -> list[tuple[int, int, str, int, int]]:
    found = [(*m.span(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(*m.span(), "hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _suspects(column: pa.Array, texts: list[str]) -> np.ndarray:
    """Which documents can have any span: a keyword, or a run of the alphabet of MIN_RUN or more."""
    runs = W.split(column, IN_RUN)
    far = np.concatenate([[0], np.cumsum(runs.end - runs.start >= MIN_RUN)])
    some = np.diff(far[runs.first]) > 0
    for d, text in enumerate(texts):
        if not some[d] and (":" in text or "=" in text):
            low = text.lower()
            some[d] = any(k in low for k in KEYWORDS)
    return some


def _transitions(data: np.ndarray) -> np.ndarray:
    code = CODE[data]
    return np.bincount(np.concatenate([[0], code[:-1]]) * SYMBOLS + code, minlength=SYMBOLS * SYMBOLS)


CLASS = np.array([0] + [1] * 26 + [2] * 26 + [3] * 10 + list(range(4, 4 + SYMBOLS - 63)))  # other, capital, small, digit, each sign
SMALL = np.zeros(256, dtype=np.int64)  # letters, without case, as 0 to 25
SMALL[:] = -1
SMALL[0x41:0x5B] = SMALL[0x61:0x7B] = np.arange(26)


def _identifiers(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transitions inside the words of a slice, taken in pairs as identifiers of every form."""
    letter = SMALL[buffer]
    words = W.split_bytes(buffer, offsets, letter >= 0)
    n = len(words.start)
    if n < 2:
        return np.zeros(SYMBOLS * SYMBOLS, dtype=np.int64)
    first, last = letter[words.start], letter[words.end - 1]
    at = np.flatnonzero((letter[1:] >= 0) & (letter[:-1] >= 0))
    inner = np.bincount(letter[at] * 26 + letter[at + 1], minlength=676)
    long = words.end - words.start > 1
    opening = np.bincount(first[long] * 26 + letter[words.start[long] + 1], minlength=676)
    between = np.bincount(last[:-1] * 26 + first[1:], minlength=676)
    begins, ends = np.bincount(first, minlength=26), np.bincount(last, minlength=26)
    out = np.zeros((SYMBOLS, SYMBOLS), dtype=np.int64)
    upper, lower = slice(1, 27), slice(27, 53)
    square = lambda x: x.reshape(26, 26)
    # Words in small letters (snake, kebab), with a capital (camel) and in capitals.
    out[lower, lower] += 2 * square(inner) + square(inner - opening)
    out[upper, lower] += square(opening)
    out[upper, upper] += square(inner)
    out[lower, upper] += square(between)
    for sign, small, copies in ((b"_", lower, 1), (b"-", lower, 1), (b"_", upper, 1)):
        code = int(CODE[sign[0]])
        out[small, code] += copies * ends
        out[code, small] += copies * begins
    out[0, lower] += begins
    out[0, upper] += begins
    # name2, name_v2, NAME_2
    digit = slice(53, 63)
    some = n // VERSIONED // 10 + 1
    for small in (lower, upper):
        out[small, digit] += (ends[:, None] // (VERSIONED * 10)).astype(np.int64)
        out[26 + 22 if small is lower else 22, digit] += some
    out[int(CODE[ord("_")]), digit] += some
    return out.reshape(-1)


def _count(batches):
    """(random, cell, n): transitions inside labelled values and outside base spans."""
    totals = np.zeros((2, SYMBOLS * SYMBOLS), dtype=np.int64)
    for whole in batches:
        for batch in W.slices(whole, "text"):
            column = batch.column("text")
            buffer, offsets = W.text_bytes(column)
            code = CODE[buffer]
            before = np.concatenate([[0], code[:-1]]) if len(code) else code
            before[offsets[:-1][offsets[:-1] < len(code)]] = 0
            totals[0] += np.bincount(before * SYMBOLS + code, minlength=SYMBOLS * SYMBOLS)
            totals[0] += _identifiers(buffer, offsets)
            texts = [t or "" for t in column.to_pylist()]
            for d in np.flatnonzero(_suspects(column, texts)):
                end = 0
                for a, b, _, value, stop in _base(texts[d]):
                    inside = np.frombuffer(texts[d][value:stop].encode("ascii"), dtype=np.uint8)
                    if a >= end:  # nested spans are labelled once
                        totals[1] += _transitions(inside)
                        totals[0] -= _transitions(np.frombuffer(texts[d][a:b].encode(), dtype=np.uint8))
                        end = b
    np.maximum(totals, 0, out=totals)
    label, cell = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell.astype(np.int32)),
                                      pa.array(totals[label, cell])], names=["random", "cell", "n"])


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios log P(next | last, random) - log P(next | last, identifier).

    Each model is a mixture of add-one smoothed characters and BACKOFF of classes.
    """
    rows = (docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "random int, cell int, n bigint")
            .groupBy("random", "cell").agg(F.sum("n").alias("n")).collect())  # at most 2 x SYMBOLS^2
    table = np.zeros((2, SYMBOLS, SYMBOLS))
    for r in rows:
        table[r.random, r.cell // SYMBOLS, r.cell % SYMBOLS] = r.n
    classes = int(CLASS.max()) + 1
    member = np.eye(classes)[CLASS]
    size = member.sum(axis=0)
    by_class = np.einsum("mij,ik,jl->mkl", table, member, member) + size[None, None, :]
    by_class[:, :, 0] = 0
    by_class /= by_class.sum(axis=2, keepdims=True)
    spread = np.einsum("mkl,ik,jl->mij", by_class / size, member, member)[:, :, 1:]
    table = table[:, :, 1:] + 1
    table = (1 - BACKOFF) * table / table.sum(axis=2, keepdims=True) + BACKOFF * spread
    ratio = np.zeros((SYMBOLS, SYMBOLS))
    ratio[:, 1:] = np.log(table[1]) - np.log(table[0])
    return ratio


def likelihood_ratio(run: str, ratio: np.ndarray) -> float:
    code = CODE[np.frombuffer(run.encode("ascii"), dtype=np.uint8)]
    return float(ratio[np.concatenate([[0], code[:-1]]), code].sum())


def spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, str, int]]:
    """All spans (start, kind's place, kind, end) by start, then kind."""
    found = base_spans(text)
    base = [(a, b) for a, _, _, b in found]
    at, covered = 0, 0  # base spans before ``at`` begin before the place that is looked at; they reach to ``covered``
    for m in RUN.finditer(text):
        place, end = m.span()
        while place < end:
            while at < len(base) and base[at][0] <= place:
                covered = max(covered, base[at][1])
                at += 1
            if covered > place:
                place = covered
                continue
            stop = min(end, base[at][0]) if at < len(base) else end
            score = likelihood_ratio(text[place:stop], ratio) if stop - place >= MIN_RUN else 0.0
            if score >= IN_TOTAL and score >= PER_CHARACTER * (stop - place):
                found.append((place, KINDS.index("random"), "random", stop))
            place = stop
    return sorted(found)


def _scanned(column: pa.Array, ratio: np.ndarray):
    """For each document its text and its spans."""
    texts = [t or "" for t in column.to_pylist()]
    some = _suspects(column, texts)
    return texts, [spans(t, ratio) if s else [] for t, s in zip(texts, some, strict=True)]


def scanner(ratio: np.ndarray):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan_batches(batches):
        for whole in batches:
            for batch in W.slices(whole, "text"):
                _, found = _scanned(batch.column("text"), ratio)
                rows = [[{"kind": k, "start": a, "end": b} for a, _, k, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, type=kind)], names=["id", "spans"])

    return scan_batches


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: np.ndarray | None = None) -> DataFrame:
    """(id, spans) for every row: the base rules' and the model's spans, in order."""
    ratio = train(docs, text_col) if ratio is None else ratio
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        scanner(ratio), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def mask(text: str, found: list[tuple[int, int, str, int]], by: str = MASK) -> str:
    """The text with every span replaced; overlapping spans count as one."""
    out, at = [], 0
    for a, _, _, b in found:
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
             ratio: np.ndarray | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with secrets masked; ``chars_col``, if there, counts the new text."""
    ratio = train(docs, text_col) if ratio is None else ratio
    docs, back = set_aside(docs, "_masked", "_length")
    text_col, chars_col = now_named(back, text_col), now_named(back, chars_col)

    def clean(batches):
        for whole in batches:
            for batch in W.slices(whole, text_col):
                texts, found = _scanned(batch.column(text_col), ratio)
                masked = [mask(t, x) if x else None for t, x in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(masked, type=pa.string()),
                     pa.array([m and len(m) for m in masked], type=pa.int64())],
                    names=[*batch.schema.names, "_masked", "_length"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_masked", T.StringType()), T.StructField("_length", T.LongType())])
    out = docs.mapInArrow(clean, schema)
    new = {text_col: F.coalesce("_masked", F.col(text_col))}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("_masked").isNotNull(), F.col("_length")).otherwise(F.col(chars_col)).cast(
            docs.schema[chars_col].dataType)
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns)).withColumnsRenamed(back)
