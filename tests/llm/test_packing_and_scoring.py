"""Packing by exact round trip; lattice scores against an enumeration of all segmentations."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import public_tokenizers
import pytest
from llm_data import EDGES
from pyspark.sql import functions as F

from acqlens.llm import lattice, packing

BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def check_packing(df, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    rows = packing.pack(df, BPE, window=window).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
    want = Counter()
    for doc in df.collect():
        want[(doc.doc_id, *tokenizer.encode(doc.text or "", add_special_tokens=False).ids, 1)] += 1
    if len(set(x[0] for x in want)) == sum(want.values()):  # unique ids: each id lies in exactly one piece
        for key in want:
            pieces = sorted(docs[key[0]], key=lambda r: r.start)
            assert [i for r in pieces for i in r.ids] == list(key[1:])
            assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
    assert sum(r.length for r in rows) == sum((len(k) - 1) * n for k, n in want.items())
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and size <= window
        padding += 0 if size & (size - 1) == 0 else window - size
    return padding / max(1, sum(r.length for r in rows))


def test_round_trip_and_padding(documents):
    assert check_packing(documents) < 0.005


def test_edge_cases(edges, make_docs):
    check_packing(edges)
    odd = ["don't STOP 3²½ ª", "Σίσυφος ΑΣ", "étè", "İstanbul", "a b\x1cc\x85d", "<|endoftext|> '' 's ''s x's", "日本語 text"]
    check_packing(make_docs(list(enumerate(odd))))
    assert packing.pack(make_docs([]), BPE).collect() == []


def test_texts_of_special_tokens_are_encoded_as_the_tokenizer_does(make_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "<|endoftext", "é <|endoftext|> 漢", "a < |endoftext|> b"]
    pieces = sorted(packing.pack(make_docs(list(enumerate(texts))), BPE).collect(), key=lambda r: (r.doc_id, r.start))
    for i, text in enumerate(texts):
        assert [x for r in pieces if r.doc_id == i for x in r.ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_closest_is_the_best_subset_sum():
    rng = random.Random(8)
    for _ in range(200):
        lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 9))]
        waiting = defaultdict(deque)
        for x in lengths:
            waiting[x].append(x)
        space = rng.randrange(0, 90)
        chosen = packing.closest(waiting, sum(1 << x for x in waiting), space)
        assert all(n <= len(waiting[x]) for x, n in chosen.items())
        best = max(s for m in range(1 << len(lengths)) if (s := sum(x for i, x in enumerate(lengths) if m >> i & 1)) <= space)
        assert sum(x * n for x, n in chosen.items()) == best


def test_piece_cache_turns_over(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 5)
    coder = packing.Encoder(BPE)
    texts = [f"word{i} the {i} of the word{i % 3}" for i in range(60)]
    alone = [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for t in texts for x in coder.encode([t])] == alone


def all_segmentations(word, logp, vocab):
    """Probability of a word summed over every way to cut it."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        k = vocab.index.get(word[:j])
        if k is not None:
            total += math.exp(logp[k]) * all_segmentations(word[j:], logp, vocab)
        elif j == 1:
            n = len(word[0].encode())
            total += math.exp(n * (logp[vocab.n] - math.log(256))) * all_segmentations(word[1:], logp, vocab)
    return total


def test_forward_equals_enumeration(monkeypatch):
    vocab = lattice.vocabulary(PIECES)
    for word in ("the", "ereanin", "ciónes", "日x", "🙂a", "zzqj"):
        w = lattice.SPACE + word
        want = math.log(all_segmentations(w, vocab.start, vocab))
        assert lattice.forward([w], vocab.start, vocab)[0] == pytest.approx(want, rel=1e-9)
        assert lattice._forward_one(w, vocab.start, vocab) == pytest.approx(want, rel=1e-9)


def test_expected_counts_agree_between_vector_and_scalar_paths(monkeypatch):
    vocab = lattice.vocabulary(PIECES)
    words, weight = [lattice.SPACE + w for w in ("erean", "thing", "日本語xy")], np.array([2.0, 1.0, 3.0])
    fast = lattice.expected(words, weight, vocab.start, vocab)
    monkeypatch.setattr(lattice, "LONG", 0)
    assert np.allclose(fast, lattice.expected(words, weight, vocab.start, vocab))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def check_scores(df, got):
    fold = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(r.doc_id, [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] + ["\n"])
              for r in df.collect()]
    counts = Counter(w for i, ws in tokens if not fold(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((repr(i), fold(i), len(ws), sum(counts[w] > 0 for w in ws), total,
                   sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)) for i, ws in tokens)
    have = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    assert len(want) == len(have)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_base_scores_and_shuffled_words(documents, monkeypatch):
    whole = lattice.scored(documents, PIECES, held_out()).collect()
    check_scores(documents, whole)
    monkeypatch.setattr(lattice, "FREQUENT", 50)  # nearly every word goes through the join
    by_join = {r.doc_id: r.score for r in lattice.scored(documents, PIECES, held_out()).collect()}
    assert all(by_join[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in whole)


def test_training_helps_on_held_out_documents(documents):
    untrained = sum(r.score for r in lattice.scored(documents, PIECES, held_out(), rounds=0).where("held_out").collect())
    assert sum(r.score for r in lattice.scored(documents, PIECES, held_out()).where("held_out").collect()) > untrained


def test_whole_words_help_on_held_out_documents(documents, monkeypatch):
    held = lambda: sum(r.score for r in lattice.scored(documents, PIECES, held_out()).where("held_out").collect())
    mixed = held()
    pieces_alone = lattice.WholeWords(1, math.inf, 1.0)
    monkeypatch.setattr(lattice.WholeWords, "of", staticmethod(lambda *counts: pieces_alone))
    assert mixed > held()


def test_scores_equal_the_marginal_of_every_word_by_enumeration(make_docs, monkeypatch):
    texts = ["the cat the dog", "cat ereanin the", "dog", "", None, "zzqj unseen the", "a cat", "日x"]
    df = make_docs(list(enumerate(texts)))
    words = [(r.doc_id, (r.text or "").split()) for r in df.collect()]
    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in words}
    for rounds in (0, 1):
        learnt = []
        original = lattice.fit
        monkeypatch.setattr(lattice, "fit", lambda *a, f=original, to=learnt: to.append(f(*a)) or to[-1])
        got = {r.doc_id: r.score for r in lattice.scored(df, PIECES, held_out(), rounds=rounds).collect()}
        monkeypatch.setattr(lattice, "fit", original)
        (logp,), vocab = learnt, lattice.vocabulary(PIECES)
        counts = Counter(w for i, ws in words if not fold[i] for w in ws)
        once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
        docs = sum(not fold[i] for i, _ in words)
        total, types = sum(counts.values()) + docs, len(counts) + 1
        discount = (once + 1) / (once + 2 * twice + 2)
        own = lambda c: max(c - discount, 0) / total
        rest = discount * types / total
        end = own(docs) + rest * math.exp(logp[-1])
        for i, ws in words:
            want = math.log10(end) + sum(
                math.log10(own(counts[w]) + rest * all_segmentations(lattice.SPACE + w, logp, vocab)) for w in ws)
            assert got[i] == pytest.approx(want, rel=1e-9)


def test_word_probabilities_sum_to_one_with_the_share_of_pieces():
    counts = np.array([5, 3, 2, 2, 1, 1, 1])
    whole = lattice.WholeWords.of(int(counts.sum()), len(counts), 3, 2)
    alone = 10 ** whole.mixed(counts, np.full(len(counts), -np.inf))
    assert alone.sum() + whole.pieces == pytest.approx(1)
    assert lattice.WholeWords.of(0, 0, 0, 0).mixed(np.zeros(1), np.log([0.25]))[0] == pytest.approx(math.log10(0.25))


def test_scores_of_edge_cases(edges, make_docs):
    check_scores(edges, lattice.scored(edges, PIECES, held_out()).collect())
    assert lattice.scored(make_docs([]), PIECES, held_out()).collect() == []
    assert len(EDGES) == edges.count()
