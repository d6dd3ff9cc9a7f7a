from collections import Counter, defaultdict

import re

from attestor.llm import mixing, queries


def waterfill(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(limit * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else weight[s] * rest / free for s in order}
        new = {s for s in order if s not in full and target[s] > limit * sizes[s]}
        if not new:
            return target
        full |= new


def verify(rows, docs):
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = waterfill(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(mixing.BLOCK_WORDS, 0.01 * target[s]), s
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((k, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, _, t in docs)


def test_small_sources_at_their_limit_nulls_and_repeats(spark):
    docs = [(i, "big", "w " * (i % 50)) for i in range(400)] + [(1000, "tiny", "a b c"), (1001, None, "x " * 30), (None, "b", "\t"), (1002, "b", None), (1003, "b", "y " * 500)]
    docs += [(7, "same", "k " * 10)] * 50
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, taken int")
    rows = mixing.mix(df).collect()
    verify(rows, docs)
    assert Counter(rows) == Counter(mixing.mix(df.repartition(7)).collect())


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "a", "")], "doc_id long, source string, text string")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)]


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100, 1000):
        got = {r[0] for r in spark.range(n).select(mixing.permute(F.col("id"), F.lit(n), F.lit(5))).collect()}
        assert got == set(range(n))


def shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    goal, _ = mixing.plan(mixing.celled(docs.select("doc_id", "source", mixing.n_words(docs.text).alias("size")), docs_per_cell=20))
    return goal, goal.collect()


def test_counts_of_a_shard_are_multinomial_and_totals_are_met(spark):
    goal, held = shares(spark)
    slots = {r["rank"]: r.slots for r in held}
    total, size = sum(slots.values()), 200
    draws = {(r.shard, r["rank"]): len(r.held) for r in mixing.drawn(goal, shard_slots=size).collect()}
    settled = Counter((r.shard, r["rank"]) for r in mixing.slots(goal, shard_slots=size).collect())
    whole = [s for s in range(total // size)]
    chi2 = sum((draws.get((s, k), 0) - size * n / total) ** 2 / (size * n / total) for s in whole for k, n in slots.items() if n)
    freedom = len(whole) * (sum(n > 0 for n in slots.values()) - 1)
    assert abs(chi2 - freedom) < 5 * (2 * freedom) ** 0.5
    assert len({tuple(draws.get((s, k), 0) for k in slots) for s in whole}) > len(whole) // 2
    for k, n in slots.items():
        assert sum(c for (_, r), c in settled.items() if r == k) == n
    moved = sum(abs(settled[x] - draws.get(x, 0)) for x in settled) / 2
    assert moved < 3 * len(slots) * total**0.5
    assert mixing.drawn(goal, shard_slots=size, seed=2).subtract(mixing.drawn(goal, shard_slots=size)).count()


def test_shards_are_complete_and_no_block_is_ahead_of_another(spark):
    goal, held = shares(spark)
    blocks = {r["rank"]: r.blocks for r in held}
    slots = mixing.slots(goal, shard_slots=100).collect()
    shards = defaultdict(list)
    for r in slots:
        shards[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and all(len(shards[s]) == 100 for s in sorted(shards)[:-1])
    used = defaultdict(Counter)
    for r in slots:
        used[r["rank"]][r.block] += 1
    for rank, count in used.items():
        full = [count[b] for b in range(blocks[rank])]
        assert max(full) - min(full) <= 1 and max(full) <= 3


def test_query(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    source = {d[0]: d[1] for d in docs}
    rows = queries.op7_mixing(spark, "/root/testdata/sf0.001").collect()
    from types import SimpleNamespace

    verify([SimpleNamespace(**r.asDict(), source=source[r.doc_id]) for r in rows], docs)


SCHEMA = "doc_id long, source string, text string, n_chars long, turn string, slot int, shard string, spans string, target int, rank int, block int"


def clashing():
    texts = ["one two three " * 40, "alpha\nbeta\tgamma " * 25, "", None, "  lead and trail  ", "z " * 30_000, "é ß 語 " * 90]
    rows = [(i % 9 if i % 9 else None, ["a", None, "b"][i % 3], texts[i % 7], 1, "t", 2, "s", "x", 5, 6, 7) for i in range(60)]
    return rows


def test_realized_mix_with_clashing_columns_ties_and_very_long_texts(spark):
    docs = spark.createDataFrame(clashing(), SCHEMA)
    rows = mixing.realize(docs).collect()
    assert mixing.realize(docs).columns == ["doc_id", "source", "text", "n_chars", "spans", "rank", "block", "turn", "shard", "slot"]
    again = mixing.realize(docs.repartition(5)).collect()
    assert Counter(rows) == Counter(again)
    words = Counter()
    for r in rows:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text) and r.turn < 3
    for r in mixing.mix(docs.select("doc_id", "source", "text")).select("source", "target").distinct().collect():
        assert abs(words[r.source] - r.target) <= mixing.BLOCK_WORDS + 0.01 * r.target


def test_slots_of_the_realized_mix(spark):
    docs = spark.createDataFrame(clashing(), SCHEMA)
    parts = mixing.realize(docs, per_slot=True, shard_slots=100).collect()
    fill, places = Counter(), defaultdict(set)
    for r in parts:
        fill[r.shard, r.slot] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        places[r.shard].add(r.slot)
    assert max(fill.values()) == mixing.BLOCK_WORDS and sorted(places) == list(range(len(places)))
    assert all(places[s] == set(range(100)) for s in sorted(places)[:-1])
    whole = mixing.realize(docs, shard_slots=100).collect()
    assert sum(fill.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in whole)
    assert {(r.shard, r.slot) for r in whole} <= set(fill)
    # what a document gives, by mix, is what its slots hold
    by_id = Counter()
    for r in parts:
        by_id[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert sum(r.taken for r in mixing.mix(docs.select("doc_id", "source", "text"), shard_slots=100).collect()) == sum(by_id.values())
    assert mixing.realize(docs.limit(0)).count() == 0


def test_the_draw_is_part_of_the_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "text")
    one, two = ({r.doc_id: r for r in mixing.mix(docs, shard_slots=50, seed=s).collect()} for s in (1, 2))
    assert any(one[k].first_shard != two[k].first_shard for k in one)
    assert all((r.taken > 0) == (r.first_shard is not None) == (r.pieces > 0) for r in one.values())
