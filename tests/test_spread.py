"""Medians by counting, against medians of all scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from attestor import scratch
from attestor.operators import metrics as M, retrieval as R, spread
from attestor.plans import evaluation
from tests.test_growth import rows_made

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(5)
    own = [r.normal(size=6) for _ in range(120)] + [np.ones(6)] * 40 + [r.normal(size=6) * 1e-9 + 1 for _ in range(20)]
    rows = [(i, v.tolist()) for i, v in enumerate(own)]
    rows += [(200, None), (201, [0.0] * 6), (202, [float("nan")] * 6), (203, [1.0, 2.0]), (204, [-1.0, 2.0]), (205, [3.0, 2.0]), (206, [1.0] * 9)]
    passages = spark.createDataFrame(rows, "ref long, vector array<double>").repartition(5)
    return passages, passages.where("ref % 7 = 0 OR ref >= 199").select(F.col("ref").alias("query_id"), "vector")


@pytest.mark.parametrize("block", [R.QUERY_BLOCK, 9])
def test_counting_finds_the_medians_of_all_scores(spark, tables, block, monkeypatch):
    monkeypatch.setattr(spread, "DEAL", 50)
    want = {}
    for q, score in R.cosine(*tables).select("query_id", "score").collect():
        want.setdefault(q, []).append(score)
    got = {r.query_id: r for r in spread.middles(*tables, block=block).collect()}
    assert set(got) == set(want) and {len(s) for s in want.values()} == {180, 3, 1}
    for q, scores in want.items():
        best, *others = sorted(scores, reverse=True)
        mid = np.median(others) if others else None
        assert (got[q].n, got[q].best) == (len(scores), best)
        assert got[q].mid == pytest.approx(mid, abs=1e-12) and got[q].mad == pytest.approx(np.median(np.abs(np.array(others) - mid)) if others else None, abs=1e-12)
    told = {r.query_id: r.separation for r in M.separation(R.cosine(*tables), "query_id").collect()}
    counted = {r[0]: r[1] for r in spread.middles(*tables).select("query_id", M.separated()).collect()}
    assert {q: s and round(s, 6) for q, s in counted.items()} == {q: s and round(s, 6) for q, s in told.items()}


def test_no_score_leaves_its_task(spark):
    out, most = rows_made(spark, evaluation.score_separation(spark, SF))
    assert len(out) == 10 and most <= 500


def test_no_vectors(spark, tables):
    assert spread.middles(tables[0].limit(0), tables[1]).count() == 0 == spread.middles(tables[0], tables[1].limit(0)).count()


def test_few_sweeps(spark, tables, monkeypatch):
    """Six sweeps were made, whatever the scores."""
    made, sweep = [], R.sweep
    monkeypatch.setattr(R, "sweep", lambda *a, **b: made.append(1) or sweep(*a, **b))
    assert spread.middles(*tables).count() and len(made) <= 4


def test_medians_are_found_where_the_sample_has_missed_them(spark, tables, monkeypatch):
    passages, queries = tables
    asked = queries.where("query_id < 30")
    want = {r.query_id: r for r in spread.middles(passages, asked).collect()}
    monkeypatch.setattr(spread, "SAMPLE", 66)
    monkeypatch.setattr(spread, "TOLD", 3)
    monkeypatch.setattr(spread, "STEPS", 1 << 14)
    wrong = spread._sampled

    def off(rows, many):
        work = wrong(rows, many)
        return lambda batches: (pdf.assign(low=pdf["low"] + 10**9, high=pdf["low"] + 10**9 + 5) for pdf in work(batches))

    monkeypatch.setattr(spread, "_sampled", off)
    assert {r.query_id: r for r in spread.middles(passages, asked).collect()} == want


def test_every_block_and_part_has_a_task_of_its_own(spark, tables):
    """Blocks and parts were dealt by a hash to as many tasks as the session shuffles to: some had several, others none."""
    asks = scratch.cut(R.vectors(tables[1], "query_id"), "asked")
    out = R.sweep(R.vectors(tables[0], "ref"), asks, lambda own: R.Cosines(own, 3), block=4, deal=50)
    assert out.select(F.spark_partition_id()).distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counts_of_many_queries_are_put_together_at_once():
    """Each query was a group of its own: 9 ms each, in one task as they are small."""
    rows = [{"query_id": q, "n": 3, "best": 9.0 + q, "below": 1, "over": 99, "low": 0, "high": 9, "step": 1, "steps": np.array([q, 4]), "many": np.array([1, 1])} for q in (1, 2, 1)]
    got = spread._narrowed(pd.DataFrame(rows)).set_index("query_id")
    assert got.loc[1].to_dict() == {"n": 6, "best": 10.0, "found": True, "step": 1, "low": 1, "high": 1} and got.loc[2, ["found", "high"]].tolist() == [False, -1]
