"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every document gets counts (one vectorised pass) and from them one vote per
rule: good, bad or abstain. Votes are aggregated to a histogram of vote patterns
(at most 3^rules rows, whatever the corpus size), on which expectation-
maximisation estimates the share of good documents and for each rule how often
it votes each way on good and on bad documents. Each document's posterior
probability of being good is then the logistic sum of its rules' log ratios, a
built-in column expression.

Counts: words are ``[^\\x20\\x09-\\x0D]+``; word_chars, code points in words;
n_symbols, characters of ``#*$%&|<>``; n_types, distinct words of each TYPE_WINDOW
words, summed; n_dup_lines, lines with a word that equal
an earlier line; n_repeat_words, words in three-word windows found twice or more.

Defined cases: null text counts as empty; an empty text has no votes but fails
the base rule (fewer than 50 words); repeated rows each get their verdict; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acqlens.llm import words as W
from acqlens.llm.storage import now_named, set_aside, settle

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_upper", "n_letters", "n_bangs", "n_stops", "n_types", "n_bare"]
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
GOOD, BAD, ABSTAIN = 1, 0, 2
ROUNDS = 100
KEEP = 0.5
# What rules are expected to do, as a share of the documents added to the counts of each round: it ties
# the two classes to good and bad, alike at every corpus size. By class (bad, good): bad, good, abstain.
PRIOR_SHARE = 0.05
PRIOR = np.array([[0.40, 0.45, 0.15], [0.02, 0.90, 0.08]])

# Thresholds of the rules (bad beyond one, good within the other, else abstain).
RULES: dict[str, tuple[str, float, float, float, float]] = {
    # name: (ratio, least for good, most for good, least for not bad, most for not bad)
    "symbols_per_word": ("n_symbols / n_words", 0.0, 0.02, 0.0, 0.1),
    "bare_words": ("n_bare / n_words", 0.0, 0.03, 0.0, 0.1),
    "mean_word_length": ("word_chars / n_words", 4.0, 6.2, 3.3, 7.0),
    "capitals_per_letter": ("n_upper / n_letters", 0.0, 0.08, 0.0, 0.2),
    "bangs_per_word": ("n_bangs / n_words", 0.0, 0.05, 0.0, 0.2),
    "repeated_words": ("n_repeat_words / n_words", 0.0, 0.15, 0.0, 0.35),
    "distinct_words": ("n_types / n_words", 0.45, 1.0, 0.2, 1.0),
    "duplicate_lines": ("n_dup_lines / n_lines", 0.0, 0.2, 0.0, 0.4),
    "stops_per_word": ("n_stops / n_words", 0.04, 0.4, 0.005, 1.0),
}
TYPE_WINDOW = 500  # distinct words are counted in windows of so many words, so their rate does not fall with length


def _class_counts(buffer: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(table[buffer], dtype=np.int64)])
    return np.diff(total[offsets])


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(members, dtype=np.uint8)] = True
    return table


LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 256)))  # leading bytes count once
LETTER_OR_DIGIT = LETTER | _table(b"0123456789")


def _duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """All counts of COUNTS for a slice of documents."""
    words = W.split(column, W.NON_SPACE)
    buffer, offsets = W.text_bytes(column)
    keys, first, n = words.keys(), words.first, len(column)
    per_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[first])
    chars = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80, dtype=np.int64)])
    salt = np.repeat(W.stream(5, n), words.counts) if n else np.zeros(0, dtype=np.uint64)
    value, at, _ = W.windows(keys, first, 3, short=False)
    _, where, times = np.unique(value ^ salt[at], return_inverse=True, return_counts=True)
    again = at[times[where] > 1]
    repeated = np.zeros(len(keys), dtype=bool)
    for j in range(3):
        repeated[again + j] = True
    window = (words.doc << 32) + (np.arange(len(keys)) - np.repeat(first[:-1], words.counts)) // TYPE_WINDOW
    own = W.mix(keys ^ W.mix(window.astype(np.uint64) * np.uint64(W.GOLDEN)))
    order = np.argsort(own, kind="stable")
    new = np.zeros(len(own), dtype=bool)
    new[order] = np.concatenate([[True], own[order][1:] != own[order][:-1]]) if len(own) else []
    solid = np.concatenate([[0], np.cumsum(LETTER_OR_DIGIT[buffer], dtype=np.int64)])
    bare = solid[words.end] == solid[words.start]
    lines = np.array([_duplicate_lines(t or "") for t in column.to_pylist()], dtype=np.int64).reshape(n, 2)
    return {
        "n_words": words.counts,
        "word_chars": per_word(chars[words.end] - chars[words.start]),
        "n_symbols": _class_counts(buffer, offsets, _table(SYMBOLS)),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": per_word(repeated),
        "n_lines": lines[:, 0],
        "n_upper": _class_counts(buffer, offsets, _table(bytes(range(65, 91)))),
        "n_letters": _class_counts(buffer, offsets, LETTER),
        "n_bangs": _class_counts(buffer, offsets, _table(b"!")),
        "n_stops": _class_counts(buffer, offsets, _table(b".,;:?")),
        "n_types": per_word(new),
        "n_bare": per_word(bare),
    }


def measurer(text: str, keep_text: bool):
    """Arrow function: appends the struct column ``_counts``, with or without the text itself."""

    def measure(batches):
        for whole in batches:
            for batch in W.slices(whole, text):
                found = counts(batch.column(text))
                struct = pa.StructArray.from_arrays([pa.array(found[c], type=pa.int64()) for c in COUNTS], names=COUNTS)
                names = [c for c in batch.schema.names if keep_text or c != text]
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), struct], names=[*names, "_counts"])

    return measure


def measured(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` of docs and a struct column ``_counts``; a map without shuffle."""
    keep = text_col in columns
    schema = T.StructType([*(docs.schema[c] for c in columns),
                           T.StructField("_counts", T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    source = docs.select(*columns) if keep else docs.select(*columns, text_col)
    return source.mapInArrow(measurer(text_col, keep), schema)


def votes() -> list[Column]:
    """One column per rule: 1 good, 0 bad, 2 abstain (also where the ratio is undefined)."""
    out = []
    for name, (ratio, good_low, good_high, low, high) in RULES.items():
        top, bottom = (F.col(f"_counts.{c}") for c in ratio.split(" / "))
        value = top / F.when(bottom > 0, bottom)
        out.append(F.when(value.between(good_low, good_high), GOOD).when(
            (value < low) | (value > high), BAD).otherwise(ABSTAIN).alias(name))
    return out


def expectation_maximisation(patterns: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """(share of good documents, table[class, rule, vote]) from distinct vote patterns and their counts.

    A pattern without bad votes starts as good, one with two or more as bad. PRIOR
    is added to the counts of every round; it keeps all estimates inside (0, 1).
    """
    n_rules = patterns.shape[1] if patterns.size else len(RULES)
    if not len(patterns):
        return 0.5, np.full((2, n_rules, 3), 1 / 3)
    posterior = np.array([0.95, 0.5, 0.05])[np.minimum((patterns == BAD).sum(1), 2)]
    prior = PRIOR[:, None, :] * (PRIOR_SHARE * weight.sum() + 1)
    one_hot = np.stack([patterns == v for v in range(3)], axis=2).astype(float)
    for _ in range(rounds):
        weights = np.stack([(1 - posterior) * weight, posterior * weight])
        table = np.einsum("cp,prv->crv", weights, one_hot) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = (weights[1].sum() + 1) / (weight.sum() + 2)
        logs = np.einsum("prv,crv->cp", one_hot, np.log(table)) + np.log([1 - share, share])[:, None]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    return float(share), table


def fit(measures: DataFrame) -> tuple[float, np.ndarray]:
    """EM on the histogram of vote patterns (at most 3^rules rows reach the driver).

    Documents that fail the base rule are left out: their verdict is settled.
    """
    rows = measures.where(~base_failed()).select(*votes()).groupBy(*RULES).agg(F.count(F.lit(1)).alias("_n")).collect()
    patterns = np.array([[r[c] for c in RULES] for r in rows], dtype=int).reshape(len(rows), len(RULES))
    return expectation_maximisation(patterns, np.array([r["_n"] for r in rows], dtype=float))


def posterior(model: tuple[float, np.ndarray]) -> Column:
    """The probability of being good as a column expression over ``_counts``."""
    share, table = model
    total = F.lit(float(np.log(share / (1 - share))))
    for j, vote in enumerate(votes()):
        ratio = np.log(table[1, j] / table[0, j])
        total = total + F.element_at(F.array(*(F.lit(float(x)) for x in ratio)), vote + 1)
    return 1 / (1 + F.exp(-total))


def base_failed() -> Column:
    n = F.col("_counts.n_words")
    return (n < MIN_WORDS) | (100 * F.col("_counts.n_repeat_words") > 50 * n)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five base counts, base_failed, kept, quality) for every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measures = settle(measured(docs, ["_id"], "_text"))
    model = fit(measures)
    return measures.select(F.col("_id").alias(id_col), *(F.col(f"_counts.{c}").alias(c) for c in COUNTS[:5]),
                           base_failed().alias("base_failed"), posterior(model).alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def kept_rows(docs: DataFrame, text_col: str = "text", model: tuple[float, np.ndarray] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, all columns; two map passes, no join and no shuffle of texts."""
    docs, back = set_aside(docs, "_counts")
    text_col = now_named(back, text_col)
    model = model or fit(measured(docs, [], text_col))
    return measured(docs, docs.columns, text_col).where(
        ~base_failed() & (posterior(model) >= KEEP)).select(*docs.columns).withColumnsRenamed(back)
