"""The ledger with time, in batch and as state, against a balance that is kept call by call."""

import random

import pytest
from pyspark.sql import functions as F

from attestor.operators import research
from attestor.streaming import live

CALLS = "investigation long, seq long, at timestamp, bytes long, elapsed_ms long, cached boolean"
COLUMNS = ["investigation", "seq", "requests_left", "bytes_left", "ms_left", "ms_charged", "timed_out", "decision", "exhausted"]
POOL = (9, 12_000, 700)


def calls(n, seed):
    r = random.Random(seed)
    return [(r.choice((1, 1, 1, 2, 3, 4, 5, 6, None)), i, f"2024-01-01 0{i // 60}:{i % 60:02d}:00", r.choice((None, 0, 900, 4500)), r.choice((None, 0, 1, 60, 350)), r.choice((None, True, False, False))) for i in range(n)]


def by_hand(rows):
    left, out = {}, []
    for who, seq, _, size, took, cached in sorted(rows, key=lambda c: c[1]):
        requests, space, time = left.get(who, POOL)
        size, took = size or 0, took or 0
        short = None if cached else "requests" if requests < 1 else "bytes" if space < 1024 else "time" if time < 1 else None
        charged = 0 if short else min(took, time)
        out.append((who, seq, requests, space, time, charged, not cached and not short and took > time, "cached" if cached else "network_budget_exhausted" if short else "fetch", short))
        if cached:
            left[who] = (requests, space, time - charged)
        elif not short:
            left[who] = (requests - 1, max(space - size, 0), time - charged)
    return out


@pytest.fixture(scope="module")
def rows():
    return calls(150, 3)


def table(spark, rows):
    return spark.createDataFrame(rows, CALLS.replace("timestamp", "string")).withColumn("at", F.col("at").cast("timestamp"))


@pytest.mark.parametrize("block", [None, "hour", "nulls first"])
def test_batch_equals_a_balance_kept_by_hand(spark, rows, block):
    part = {None: None, "hour": F.date_trunc("hour", F.col("at")), "nulls first": F.when(F.col("seq") >= 20, F.col("seq").cast("int"))}[block]
    got = research.timed_ledger(table(spark, rows), *POOL, part).select(*COLUMNS).collect()
    want = by_hand(rows)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert {r[8] for r in want} == {None, "requests", "bytes", "time"} and any(r[6] for r in want)


def test_stream_equals_a_balance_kept_by_hand(spark, rows, tmp_path):
    got = []
    for low, high in ((0, 40), (40, 41), (41, 150)):  # three runs that share a checkpoint
        table(spark, rows).where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = live.timed_ledger(spark.readStream.schema(CALLS).parquet(f"{tmp_path}/in"), *POOL).writeStream.outputMode("append")
        out.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.select(*COLUMNS).collect()))).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(got, key=lambda r: r[1]) == by_hand(rows)


def test_no_calls(spark):
    assert research.timed_ledger(table(spark, []), *POOL, F.col("seq")).count() == 0
