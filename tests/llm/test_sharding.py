import zlib
from collections import Counter

from attestor.llm import queries, sharding


def by_hand(cells, shards, vnodes, slack, seed):
    """One row at a time: the first shard clockwise that isn't full."""
    owner = sharding.ring(shards, vnodes, seed)
    room, held, out = sharding.bounds(len(cells), shards, slack), Counter(), []
    for cell in sorted(cells):
        at = cell % (1 << sharding.MIN_BITS)
        while owner[at] is None or held[owner[at]] >= room[owner[at]]:
            at = (at + 1) % (1 << sharding.MIN_BITS)
        out.append((cell, owner[at], held[owner[at]]))
        held[owner[at]] += 1
    return out


def test_equals_sequential_placement(spark):
    df = spark.range(3000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "doc_id AS shard", "1 AS `odd name`")
    for slack in (0.0, 0.1):
        rows = sharding.assign(df, "doc_id", 16, slack=slack, seed=3).withColumn("cell", sharding.cell_of(df.doc_id, 3)).collect()
        assert Counter((r.cell, r.shard) for r in rows) == Counter((c, s) for c, s, _ in by_hand([r.cell for r in rows], 16, 64, slack, 3))
        held = Counter(r.shard for r in rows)
        assert max(held.values()) <= (1 + slack) * 3000 / 16 + 1
        assert sorted((r.shard, r.slot) for r in rows) == [(s, i) for s in sorted(held) for i in range(held[s])]
        assert {r["odd name"] for r in rows} == {1}


def test_movement_is_limited_when_a_shard_is_added(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r for r in sharding.assign(df, "doc_id", 16, slack=0.25).collect()}
    after = {r.doc_id: r for r in sharding.assign(df, "doc_id", 17, slack=0.25).collect()}
    assert all(after[k].home_shard in (before[k].home_shard, 16) for k in before)
    assert sum(before[k].shard != after[k].shard for k in before) < 0.35 * len(before)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None,)] * 5 + [(7,)] * 40 + [(8,)], "doc_id long")
    rows = sharding.assign(df, "doc_id", 16).collect()
    held = Counter(r.shard for r in rows)
    assert len(rows) == 46 and max(held.values()) - min(held.values()) <= 1 and len(held) == 16
    assert sharding.assign(df.limit(0), "doc_id", 16).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op1_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in docs.items()}
    held = Counter(r.shard for r in rows)
    assert max(held.values()) - min(held.values()) <= 1 and {r.law for r in rows} == {"rows"}
    assert rows == queries.op1_sharding(spark, "/root/testdata/sf0.001").collect() or sorted(rows) == sorted(queries.op1_sharding(spark, "/root/testdata/sf0.001").collect())


def test_null_ids_are_spread_and_tied_rows_take_slots_of_their_own(spark, monkeypatch):
    rows = [(None, i, "x") for i in range(3000)] + [(5, 1, "x"), (5, 1, "x"), (5, 2, "x")]
    df = spark.createDataFrame(rows, "doc_id long, size int, slot string")
    code = sharding.cell_of(df.doc_id, 1, ties=(df["size"],))
    assert df.where("doc_id IS NULL").select(code.alias("c")).distinct().count() > 2000
    got = sharding.assign(df, "doc_id", 16, ties=("size",))
    assert got.columns == ["doc_id", "size", "home_shard", "shard", "slot"]
    held = Counter(r.shard for r in got.collect())
    assert max(held.values()) - min(held.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(s, i) for s in sorted(held) for i in range(held[s])]
    assert Counter(got.collect()) == Counter(sharding.assign(df.repartition(9), "doc_id", 16, ties=("size",)).collect())


def test_segments_follow_nodes_and_rows():
    assert sharding.bits_for(1000, 16, 64) == sharding.bits_for(1000, 64, 64) == 12 and sharding.bits_for(1000, 100, 64) == 13
    assert sharding.bits_for(10**9, 16, 64) == 14 and sharding.bits_for(10**13, 16, 64) == sharding.MAX_BITS
    assert len({s for s in sharding.ring(500, 64, 1, 15) if s is not None}) == 500
