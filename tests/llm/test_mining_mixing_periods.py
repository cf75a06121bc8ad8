"""Collocations, source mixing and periodic runs against brute force and their SQL."""

import random
import re
from collections import Counter
from fractions import Fraction
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_data import EDGES, SCHEMA, SF

from acqlens.llm import automata, collocations, mixing, periods, queries


def by_sql(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents.toArrow())
    found = con.sql(sql)
    return found.columns, sorted(found.fetchall(), key=repr)


def agrees(query, sql, spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    columns, want = by_sql(sql, docs)
    got = query(spark, str(folder)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == want
    return got


# collocations

def random_paths(rng, n, labels=6):
    paths = Counter()
    for _ in range(n):
        paths[tuple(rng.randrange(labels) for _ in range(rng.randrange(1, automata.DEPTH + 1)))] += rng.randrange(1, 4)
    rows = sorted(paths)
    full = np.array([[*r, *[-1] * (automata.DEPTH - len(r))] for r in rows], dtype=np.int32).reshape(-1, automata.DEPTH)
    return paths, full, np.array([paths[r] for r in rows], dtype=np.int64)


@pytest.mark.parametrize("block", [1, 8, 1 << 16])
def test_transducers_give_back_their_paths_and_count_prefixes(monkeypatch, block):
    monkeypatch.setattr(automata, "BLOCK", block)
    rng = random.Random(block)
    texts = pa.array([*"bcdefgh"], type=pa.large_string())
    for n in (0, 1, 5, 300):
        paths, full, counts = random_paths(rng, n)
        made = automata.Builder()
        made.add(full, counts)
        one = automata.Transducer.from_bytes(made.finish(texts).to_bytes())
        labels = [ord(x) - ord("b") for x in one.texts.to_pylist()]
        got, times = one.paths()
        assert {tuple(labels[x] for x in r if x >= 0): c for r, c in zip(got.tolist(), times.tolist(), strict=True)} == dict(paths)
        if n:
            of = {x: i for i, x in enumerate(labels)}
            wanted = np.array([[of[x] if x >= 0 else -1 for x in r] for r in full.tolist()])
            for row, written in zip(full.tolist(), one.walk(wanted).tolist(), strict=True):
                for depth in range(sum(x >= 0 for x in row)):
                    assert written[depth] == sum(c for p, c in paths.items() if p[: depth + 1] == tuple(row[: depth + 1]))


def test_equal_endings_are_one_state():
    rows = np.array([[a, 0, 1, 2, 3, 4] for a in range(50)], dtype=np.int32)
    made = automata.Builder()
    made.add(rows, np.ones(50, dtype=np.int64))
    one = made.finish(pa.array([f"{i:02}" for i in range(50)], type=pa.large_string()))
    assert len(one.first) - 1 == 7 and len(one.label) == 55  # one state for each depth, and the root's arcs


def brute_collocations(rows, least, top):
    words, phrases = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            phrases.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    frequent = {k: n for k, n in phrases.items() if n >= least and len(k[1]) > 1}
    out = []
    for lang in words:
        best = []
        for (of, p), a in frequent.items():
            if of != lang or any(f == of and 100 * n >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                                 for (f, q), n in frequent.items() if len(q) > len(p)):
                continue
            cuts = [(1000 * a * words[lang] // (phrases[lang, p[:k]] * phrases[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), phrases[lang, p[:k]], phrases[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


def collocation_rows(seed):
    """Few words, so that phrases repeat; a pair that holds a third of all words; breaks, other scripts, odd white space."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "B", "cc", "ddd", "é", "漢字", "x\x0by", "it's", "«q»", "\x00", "z　z"]
    rows = [(None, None), ("en", ""), ("en", " \t\n"), ("en", "one")]
    for _ in range(120):
        lang = rng.choice(["en", "en", "de", None, "tab\tlang"])
        tokens = []
        for _ in range(rng.randrange(60)):
            tokens += ["hot", "Pair"] if rng.random() < 0.3 else [rng.choice(vocabulary)]
            if rng.random() < 0.1:
                tokens.append(rng.choice([".", ",", "!", "\n", ";"]))
        rows.append((lang, rng.choice([" ", "\t", "  "]).join(tokens)))
    return [*rows, *rows[-30:]]


@pytest.mark.parametrize("places,sample", [(1 << 19, 1 << 11), (50, 3), (400, 7)])
def test_collocations_equal_brute_force_whatever_the_cells(spark, monkeypatch, places, sample):
    monkeypatch.setattr(collocations, "CELL_PLACES", places)
    monkeypatch.setattr(collocations, "SAMPLE", sample)
    monkeypatch.setattr(collocations, "SHARD_PATHS", 300)  # several shards a task
    rows = collocation_rows(places)
    df = spark.createDataFrame([(i, t, lang, "x", "y", 1) for i, (lang, t) in enumerate(rows)],
                               "doc_id int, text string, lang string, cell string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=8, top=40).collect())
    assert got == brute_collocations(rows, 8, 40) and len(got) > 60
    assert max(r[1] for r in got) == 40  # the limit is met


def test_collocation_query_equals_its_sql(spark, documents, tmp_path):
    extra = [(None, "The Cat  sat\ton. the cat sat on, THE cat sat on " * 60, None, None, None), (1, None, "en", None, None)]
    docs = documents.union(spark.createDataFrame(extra, SCHEMA))
    assert agrees(queries.op11_collocation_mining, queries.OP11_SQL, spark, docs, tmp_path)


def test_collocations_of_empty_tables(spark, make_docs, edges):
    assert collocations.collocations(make_docs([])).collect() == [] and collocations.collocations(make_docs([(1, None)])).collect() == []
    got = collocations.collocations(edges).collect()
    assert sorted((r.phrase, r.a, r.lang) for r in got) == [(" ".join(["word"] * m), 30_001 - m, "und") for m in range(2, 6)]


# source mixing

def test_mix_equals_its_sql(spark, documents, tmp_path):
    extra = [(7, "a b c " * 200, "en", None, None)] * 40 + [(None, "x y", "en", "", None), (8, None, "en", "empty", None), (9, "one", "en", "Z", None),
             (10, "w " * 150_000, "en", "long", None)] + [(100, "same row " * 40, "en", "copies", None)] * 900
    agrees(queries.op12_source_mixing, queries.OP12_SQL, spark, documents.union(spark.createDataFrame(extra, SCHEMA)).repartition(7), tmp_path)


def check_mix(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size(t) for _, x, t in rows if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    stopped: set = set()
    while True:
        left, open_ = sum(whole.values()) - sum(3 * whole[s] for s in stopped), [s for s in sources if s not in stopped]
        target = {s: 3.0 * whole[s] if s in stopped else left * weight[s] / sum(weight[x] for x in open_) for s in sources}
        more = {s for s in open_ if target[s] > 3 * whole[s]}
        if not more:
            break
        stopped |= more
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == whole[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.size == size(r.text)
    return target, taken


def test_mix_meets_targets_and_caps(spark, documents):
    rng = random.Random(2)
    rows = [(i, rng.choice(["small", "big", "big", "big", "mid", None]) if i else "tiny", " ".join("w" * rng.randrange(1, 400))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string")
    mixed = mixing.mix(df).withColumnRenamed("doc_id", "id")
    got = mixed.join(df, mixed.id == df.doc_id).collect()
    target, taken = check_mix(rows, got)
    for s, want in target.items():
        assert abs(taken[s] - want) <= 2 * mixing.BLOCK_WORDS + 0.002 * want
    assert any(want == 3.0 * sum(len(t.split()) for _, x, t in rows if x == s) for s, want in target.items())
    assert sorted(tuple(r) for r in mixing.mix(df.repartition(11)).collect()) == sorted(tuple(r) for r in mixed.collect())


@pytest.mark.parametrize("seed", range(4))
def test_quotas_are_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    claims = [(f"{i:03}", rng.choice([0.0, rng.random(), 5 * rng.random(), 2.5, 300 * rng.random()]), rng.choice([3, 10, 1000])) for i in range(rng.choice([1, 7, 200]))]
    got = {r.shard_key: r.seats for r in mixing.quotas(spark.createDataFrame(claims, "shard_key string, claim double, most bigint")).collect()}
    seats = int(sum(c for _, c, _ in claims) + 1e-6)
    offers = sorted(((2 * k + 1) / (2 * c), key) for key, c, most in claims if c > 0 for k in range(min(most, seats + 1)))
    want = Counter(key for _, key in offers[:seats])
    capped = any(c > most for _, c, most in claims)
    assert all(got[key] <= most for key, _, most in claims) and (capped or got == {key: want[key] for key, _, _ in claims})


def test_mix_of_edge_tables(spark, make_docs, edges):
    assert mixing.mix(make_docs([])).collect() == []
    got = mixing.mix(edges).collect()
    assert len(got) == len(EDGES) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert all((r.target, r.taken) == (0.0, 0) for r in mixing.mix(make_docs([(1, None), (2, " ")])).collect())


# periodic runs

def brute_runs(words):
    out, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def test_mismatches_are_sums_of_squared_differences():
    rng = np.random.default_rng(4)
    for width, window in ((8, 22), (16, 46), (64, 190), (5, 9)):
        blocks, windows = rng.integers(0, 2**20, (3, width)), rng.integers(0, 2**20, (3, window))
        got = periods.mismatches(blocks.astype(np.uint64), windows.astype(np.uint64))
        want = [[sum((int(b[i]) - int(w[d + i])) ** 2 for i in range(width)) % periods.PRIME for d in range(window - width + 1)]
                for b, w in zip(blocks, windows, strict=True)]
        assert got.tolist() == want


def test_runs_equal_brute_force():
    rng, n = random.Random(1), 0
    for _ in range(300):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            w = [rng.randrange(1, rng.choice([2, 3, 4, 50])) for _ in range(rng.choice([0, 1, 10, 40, 100, 300]))]
            for _ in range(rng.randrange(5)):
                q = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 30, 40])
                base, at = [rng.randrange(1, rng.choice([2, 3, 60])) for _ in range(q)], rng.randrange(len(w) + 1)
                w[at:at] = [base[i % q] for i in range(rng.randrange(1, 5 * q + 30))]
            docs.append(w)
        first = np.cumsum([0, *map(len, docs)])
        got = periods.all_runs(np.array([x for d in docs for x in d], dtype=np.uint64), first)
        for d, w in enumerate(docs):
            want = brute_runs(w)
            n += len(want)
            assert got.get(d, []) == want
    assert n > 500


def want_of(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(doc).encode()), len(w)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_periodic_query_equals_brute_force(spark, documents, make_docs, tmp_path):
    rng = random.Random(6)
    planted = [(-i, " ".join(rng.choice("ab") for _ in range(rng.randrange(200))) + " x y z" * rng.randrange(30)) for i in range(1, 60)]
    docs = documents.where("length(text) < 20000").union(make_docs([*EDGES[:7], *planted, (900, "a " * 500), (901, "a b " * 300 + "c " * 40), (901, "é　x\n" * 60)]))
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((want_of(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r[1] for r in got) > 60


def test_runs_of_edge_tables(make_docs, edges):
    assert periods.find(make_docs([])).collect() == []
    rows = {r.doc_id: r for r in periods.find(edges).collect()}
    assert rows[1].runs == [] and rows[1].collapsed == "" and rows[8].collapsed == "word" and rows[8].runs[0].length == 30_000
    assert periods.find(edges).count() == len(EDGES)


def test_long_periods_in_a_long_text(make_docs):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(3000)]
    words = [f"v{rng.randrange(900)}" for _ in range(5000)] + base * 4 + base[:100] + [f"v{rng.randrange(900)}" for _ in range(777)]
    row = periods.find(make_docs([(1, " ".join(words))])).first()
    run = max(row.runs, key=lambda r: r.length)
    assert (run.start, run.length, run.period) == (5000, 12_100, 3000)
    assert row.collapsed.split(" ") == words[:8000] + words[17_100:]


def test_smallest_table_keeps_its_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op12_source_mixing(spark, SF).count() == queries.op13_periodic_runs(spark, SF).count() == n
