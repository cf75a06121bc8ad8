"""N-gram Jaccard join and decontamination against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acqlens.llm import decontaminate, neardup
from acqlens.llm.components import components


def words(text):
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", (text or "").lower())


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_join(rows, threshold=0.8):
    """(class, links) by row number: every pair that shares a shingle is compared."""
    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j != i)
        for j, n in shared.items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                links[i] += 1
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        low[r] = doc if low.get(r) is None else low[r] if doc is None else min(low[r], doc)
    return sorted((repr(doc), repr(low[find(i)]), links[i]) for i, (doc, _) in enumerate(rows))


def joined(df):
    return sorted((repr(r.doc_id), repr(r.class_id), r.n_links) for r in df.collect())


def test_join_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert joined(neardup.jaccard_join(documents)) == brute_join(rows)


def test_join_of_edge_cases(edges, make_docs):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert joined(neardup.jaccard_join(edges)) == brute_join(rows)
    assert neardup.jaccard_join(make_docs([])).collect() == []


def test_large_near_copy_group_is_cut_into_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK_CLASSES", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(70):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    assert joined(neardup.jaccard_join(make_docs(rows))) == brute_join(rows)


def template_corpus(n, seed):
    """Texts that keep 110 words of a template (similarity about 0.3 to 0.6), and copies of some with one changed word."""
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(150)]
    texts = []
    for i in range(n):
        own = [f"o{i}_{k}" for k in range(40)]
        texts.append(" ".join(base[:110] + own if i % 2 else own + base[40:]))
    for i in range(0, n, 7):
        w = texts[i].split()
        w[rng.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w))
    return list(enumerate(texts))


def test_template_group_is_tightened_without_loss(make_docs, monkeypatch):
    """Chance collisions chain all texts of a template; only similar ones are left together for verification."""
    monkeypatch.setattr(neardup, "CHUNK_CLASSES", 8)
    groups = []
    tighten = neardup._tightened

    def seen(large, texts, threshold):
        found = tighten(large, texts, threshold)
        groups.append((large.groupBy("root").count().agg(F.max("count")).first()[0],
                       found.groupBy("root").count().agg(F.max("count")).first()[0]))
        return found

    monkeypatch.setattr(neardup, "_tightened", seen)
    rows = template_corpus(140, 8)
    assert joined(neardup.jaccard_join(make_docs(rows))) == brute_join(rows)
    (before, after), = groups
    assert before > 8 and after <= 4


def test_prefixes_of_similar_sets_meet():
    """Whatever the table of counts: two sets at the threshold share a key of their prefixes."""
    rng = np.random.default_rng(4)
    for size in (1, 2, 4, 5, 9, 10, 37, 200):
        often = rng.integers(0, 5, neardup.CELLS)
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 60, size).astype(np.uint64))
            swap = rng.integers(0, size // 4 + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[swap:]], rng.integers(0, 1 << 60, swap // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both / (len(a) + len(b) - both) >= 0.8:
                assert len(np.intersect1d(neardup.prefix(a, often, 0.8), neardup.prefix(b, often, 0.8)))


def test_planted_pairs_are_found(make_docs):
    """600 pairs at similarities from 0.8 up to 0.9: at least 0.99 of the links are found, and none below 0.8."""
    rng = random.Random(11)
    rows = []
    for k in range(600):
        w = [f"p{k}_{i}" for i in range(104)]
        other = list(w)
        other[rng.randrange(4, 100)] = f"y{k}"
        if k % 2:
            other[rng.randrange(4, 100)] = f"z{k}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    want = {r for r in brute_join(rows)}
    got = set(joined(neardup.jaccard_join(make_docs(rows))))
    links = sum(r[2] for r in want)
    assert links >= 600 and sum(r[2] for r in got) >= 0.99 * links and all(g[2] <= 1 for g in got)


def test_one_per_group(make_docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (2, text + " more"), (9, "other words that stand alone here"), (9, "other words that stand alone here"), (4, None)]
    kept = neardup.one_per_group(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 9]


def test_banding_reaches_its_targets():
    bands, rows = neardup.banding(0.8, 0.995, 0.02)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and 1 - (1 - 0.4**rows) ** bands <= 0.02


def test_overlaps_counts_wide_and_narrow_keys():
    rng = np.random.default_rng(1)
    sets = [np.unique(np.concatenate([np.arange(5), rng.integers(0, 4000, 300)])).astype(np.uint64) for _ in range(90)]
    expected = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    assert (neardup.overlaps(sets) == expected).all()


@pytest.mark.parametrize("edges_", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 51)], []])
def test_components(spark, edges_):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges_, "a int, b int"), "a", "b").collect()}
    parent = {x: x for e in edges_ for x in e if e[0] != e[1]}
    for _ in parent:
        for a, b in edges_:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def brute_leaks(docs, items, least=0.8):
    out = set()
    for i, text in items:
        w = words(text)
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        out |= {(doc, i) for doc, t in docs if s and len(s & shingles(t)) / len(s) >= least}
    return out


def test_leaks_equal_brute_force(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents, items).collect()}
    assert got and got == brute_leaks([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_short_item_inside_long_document(spark, make_docs):
    rng = random.Random(2)
    long = [f"v{rng.randrange(3000)}" for _ in range(20_000)]
    items = [(k, " ".join(f"q{k}_{i}" for i in range(n))) for k, n in enumerate((5, 9, 17, 33, 64, 150))]
    docs = [(10, " ".join(long))]
    for k, text in items:
        at = rng.randrange(len(long))
        docs.append((20 + k, " ".join([*long[:at], *text.upper().split(), *long[at:]])))
    docs.append((40, None))
    frame = spark.createDataFrame([*items, (98, "too short"), (99, None)], "item_id bigint, text string").withColumn("exponent", F.lit(1))
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.leaks(make_docs(docs, clash=True), frame).collect()}
    assert got == {(20 + k, k): 1.0 for k in range(len(items))}
    kept = decontaminate.decontaminated(make_docs([*docs, (None, "no id")]), frame)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 10, 40]


@pytest.mark.parametrize("size", [33, 35, 36, 59])
def test_items_with_inserted_words_are_counted_over_the_whole_document(spark, make_docs, size):
    """8, 40 or 500 words inserted at every offset, and shingles of one item scattered over a long document."""
    rng = random.Random(size)
    item = [f"i{k}" for k in range(size)]
    inserted = [" ".join([*item[:at], *(f"x{rng.randrange(10**6)}" for _ in range(n)), *item[at:]]) for n in (8, 40, 500) for at in range(size)]
    scattered = [" ".join(x for at in range(0, size, 10) for x in (*item[at : at + step], *(f"y{rng.randrange(10**6)}" for _ in range(90))))
                 for step in (10, 12, 14)]
    docs, items = list(enumerate(inserted + scattered)), [(0, " ".join(item)), (1, " ".join(item[:20]))]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(docs), frame).collect()}
    want = brute_leaks(docs, items)
    assert got == want and {(k, 0) for k in range(len(inserted))} <= want


def test_settings_miss_no_contained_item():
    """In each partition: without any q - c of its shingles a document still holds h of the k least."""
    for q in range(1, 600):
        k, h = decontaminate.setting(q)
        missed = next(m for m in range(q, -1, -1) if (q - m) / q >= 0.8)
        assert 1 <= h <= k <= q and k - missed >= h
    assert [decontaminate.setting(q)[1] for q in (1, 15, 16, 31, 32, 64, 128)] == [1, 1, 2, 2, 4, 8, 16]


def test_recall_is_whole_in_every_size_partition(spark, make_docs):
    """Items of each size partition, in documents that lack about as many shingles as may be lacking."""
    rng = random.Random(21)
    items, docs = [], []
    for number, q in enumerate((6, 12, 20, 30, 40, 60, 90, 120, 200, 300)):
        words_ = [f"m{number}_{i}" for i in range(q + 4)]
        items.append((number, " ".join(words_)))
        for t in range(12):
            changed = list(words_)
            for _ in range(max(1, int(0.2 * q) // 5 + t % 2)):
                changed[rng.randrange(len(changed))] = f"c{rng.randrange(10**7)}"
            docs.append((len(docs), " ".join([*(f"f{rng.randrange(10**4)}" for _ in range(300)), *changed])))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make_docs(docs), frame).collect()}
    want = brute_leaks(docs, items)
    assert got == want and {i for _, i in want} >= set(range(2, 10)) and len(want) < len(docs)


def test_leaks_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.leaks(make_docs([(1, "a b c d e f")]), none).collect() == []
    assert decontaminate.leaks(make_docs([]), none).collect() == []
