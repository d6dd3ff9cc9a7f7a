import math
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from attestor.llm import neardup, queries
from attestor.llm.components import components

NONE = np.zeros(neardup.SLOTS, "u1")


def shingles_of(text):
    """Independent of the operator: counts of five-word runs as strings."""
    words = text.lower().split()
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def exact_weights(texts):
    """The documented weight of every shingle from its true document frequency."""
    texts = list(texts)
    n, df = len(texts), Counter(g for t in texts for g in shingles_of(t or ""))
    return {g: 0.5 + 0.5 * math.log((n + 1) / (d + 1)) / math.log((n + 1) / 2) for g, d in df.items()}


def alike(a, b, weight):
    def jaccard(w):
        low = sum(min(a[g], b[g]) * w(g) for g in a.keys() & b.keys())
        return low / sum(max(a[g], b[g]) * w(g) for g in a.keys() | b.keys())

    return max(jaccard(lambda g: 1), jaccard(weight.__getitem__)) if a and b else 0


def brute(docs, weight=None, band=0.0):
    """Classes by comparing all pairs that share a shingle; with ``band``, pairs nearer to the threshold than that may go either way and only the sure links are returned."""
    texts, holders = {}, defaultdict(list)
    for doc, text in docs:
        if text is not None:
            texts.setdefault(text, []).append(doc)
    names = list(texts)
    own = [shingles_of(t) for t in names]
    weight = weight or defaultdict(lambda: 1)
    for i, grams in enumerate(own):
        for h in grams:
            holders[h].append(i)
    links = [(a, b) for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b} if alike(own[a], own[b], weight) >= 0.8 + band]
    if band:
        return [(texts[names[a]][0], texts[names[b]][0]) for a, b in links]
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for i, t in enumerate(names):
        members = [d for j, u in enumerate(names) if find(j) == find(i) for d in texts[u]]
        out |= {d: min(members) for d in texts[t]}
    return out


def variants(rng, n, words, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    yield " ".join(base)
    for _ in range(n - 1):
        w = base[:]
        for _ in range(rng.randrange(1, edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**9)}"
        yield " ".join(w)


def test_groups_of_copies_against_all_pairs(spark):
    rng = random.Random(4)
    texts = [t for n, words, edits in ((2, 60, 1), (5, 200, 3), (40, 150, 2), (300, 250, 3), (12, 30, 1)) for t in variants(rng, n, words, edits)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(50)] + texts[:30] + ["", "", "  ", "one two", "one two", "One  two", "a b c d e"]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, key int").repartition(6)
    rows = neardup.classes(df).collect()
    weight = exact_weights(t for _, t in docs)
    want = brute(docs, weight)
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == len(docs) and set(got) == set(want)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.01 * len(docs), len(wrong)
    links = brute(docs, weight, band=0.02)  # the operator's weights come in steps
    assert len(links) > 10_000 and sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)
    assert sum(r.kept for r in rows) == len(set(got.values()))


def test_pairs_in_a_template_family(spark, monkeypatch):
    """Every document shares a passage (similarity under 0.7 with all), and each has one partner at 0.83."""
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(184))
    docs = []
    for i in range(1500):
        own = [f"w{rng.randrange(10**9)}" for _ in range(40)]
        twin = own[:]
        for k in (5, 14, 23, 32):
            twin[k] = f"e{rng.randrange(10**9)}"
        docs += [(2 * i, passage + " " + " ".join(own)), (2 * i + 1, passage + " " + " ".join(twin))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    level = neardup.frequencies(df)
    assert 0.8 < neardup.similarity(docs[0][1], docs[1][1], level) < 0.84 and 0.6 < neardup.similarity(docs[0][1], docs[2][1], level) < 0.7
    monkeypatch.setattr(neardup, "CELL", 600, raising=False)  # several cells a bucket
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert all(c // 2 == d // 2 for d, c in got.items())
    assert sum(got[d] == d - 1 for d in range(1, 3000, 2)) >= 0.995 * 1500


def test_links_of_a_block_against_all_pairs():
    rng = random.Random(3)
    texts = [t for n, words, edits in ((40, 80, 6), (60, 150, 12), (20, 8, 2)) for t in variants(rng, n, words, edits)] + ["x y z " * k for k in range(1, 20)]
    want = brute(list(enumerate(texts)))
    for cut in (0, 70):
        blocks = [[(i, i, True, True, t) for i, t in enumerate(texts)]] if not cut else [[(i, i, i < cut, i >= cut, t) for i, t in enumerate(texts)], *([(i, i, True, True, t) for i, t in enumerate(texts) if (i < cut) == low] for low in (True, False))]
        root = list(range(len(texts)))
        for a, b in (x for rows in blocks for x in neardup.links_within(rows, NONE)):
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        assert dict(enumerate(root)) == want


def test_null_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, None), (None, "x y"), (3, "x y"), (3, "x y"), (4, "")], "doc_id long, text string")
    rows = sorted((str(r.doc_id), str(r.class_id), r.kept) for r in neardup.classes(df).collect())
    assert rows == [("1", "1", True), ("2", "2", True), ("3", "3", True), ("3", "3", True), ("4", "4", True), ("None", "3", False)]
    assert sorted(str(r.doc_id) for r in neardup.dedupe(df).collect()) == ["1", "2", "3", "4"]
    assert neardup.classes(df.limit(0)).count() == 0


def test_frequency_counters_merge_in_a_tree(spark, monkeypatch):
    texts = [f"common passage of five words {i} a{i} b{i} c{i}" for i in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    whole = neardup.frequencies(df)
    monkeypatch.setattr(neardup, "FAN_IN", 2)
    assert np.array_equal(whole, neardup.frequencies(df)) and neardup.WEIGHT[whole.max()] == neardup.FLOOR
    assert neardup.frequencies(df.limit(0)).max() == 0


def test_weights_are_inverse_document_frequencies(spark):
    """Ordinary shingles differ: held by 1, 2, 4, ... of 1024 documents."""
    texts = [" ".join(f"p{k}q{i >> k}w{j}" for k in range(11) for j in range(5)) for i in range(1024)]
    level = neardup.frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = exact_weights(texts)
    got = {}
    for k in range(11):
        gram = " ".join(f"p{k}q0w{j}" for j in range(5))
        h, c = neardup.shingles(gram)
        got[k] = neardup.weigh(h, c, level)[0]
        assert abs(got[k] - want[gram]) < 0.02, (k, got[k], want[gram])
    assert len(set(got.values())) == 11 and got[0] == 1 and got[10] == neardup.FLOOR


def test_counters_of_a_large_corpus():
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.4e6, neardup.SLOTS).astype("u8")  # ten billion documents of 300 shingles
    counts[:3] += np.array([10**10, 10**8, 10**7], "u8")
    weight = neardup.WEIGHT[neardup.levels(counts, 10**10)]
    assert weight[0] == neardup.FLOOR and weight[0] < weight[1] < weight[2] < weight[3:].min()


def test_samples_estimate_weighted_similarity():
    rng = random.Random(9)
    sample, level = neardup.Sampler(), np.random.default_rng(2).integers(0, neardup.LEVELS, neardup.SLOTS).astype("u1")
    errors = []
    for edits in (1, 3, 10):
        for repeat in (1, 2):
            for _ in range(30):
                a, b = (" ".join([t] * repeat) for t in variants(rng, 2, 300, edits))
                (ha, ca), (hb, cb) = neardup.shingles(a), neardup.shingles(b)
                x, y = (sample(h, c, level).view("u2") for h, c in ((ha, ca), (hb, cb)))
                errors.append((x == y).mean() - neardup.jaccard(ha, neardup.weigh(ha, ca, level), hb, neardup.weigh(hb, cb, level)))
    assert abs(np.mean(errors)) < 0.02


def test_very_long_texts_ties_and_clashing_columns(spark):
    rng = random.Random(12)
    long = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    near = long[:]
    near[70_000] = "edit"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, "same words " * 40_000), (4, "same words " * 40_000), (5, "same words " * 39_999), (6, " ".join(reversed(long)))]
    rows += [(7, "a short text of a few words only"), (7, "another text of quite other words here")]
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], "doc_id long, text string, class_id int, key string, hub string, value string")
    got = sorted((r.doc_id, r.class_id) for r in neardup.classes(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 7), (7, 7)]
    once = neardup.dedupe(df)
    assert once.columns == df.columns and sorted(r.doc_id for r in once.collect()) == [1, 3, 6, 7, 7]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges or [(0, 0)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {r.node: r.component for r in components(df, small=-1).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in queries.op5_neardup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs, exact_weights(t for _, t in docs))
