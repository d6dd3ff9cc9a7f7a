import numpy as np
import pytest

from attestor.llm import ann, queries


def brute(ids, x, asked, k):
    out = {}
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), d[i]) for i in order]
    return out


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_query_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    want = brute(ids, x, ids[ids % 100 == 0], 10)
    got = collect(queries.op9_ann(spark, "/root/testdata/sf0.01"))
    assert recall(got, want) >= 0.95 and {len(v) for v in got.values()} == {10}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum()), rel=1e-12)


def test_many_blocks_cells_and_query_parts(spark, monkeypatch):
    for name, n in (("BLOCK", 100), ("LEAF", 8), ("QUERIES", 7)):
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(600, 16)) + 6 * rng.normal(size=16) for _ in range(3)] + [np.ones((300, 16))]).astype("f4")
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int")
    got = collect(ann.nearest(df, df.where("vec_id % 50 = 0"), 10))
    want = brute(ids, x.astype("f8"), ids[ids % 50 == 0], 10)
    assert recall(got, want) >= 0.95
    ones = set(ids[-300:].tolist())
    for q in set(want) & ones:
        assert got[q] == [(i, 0.0) for i in sorted(ones - {q})[:10]]


def test_unusable_repeated_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [1.0, 2.0]), (100, [2.0, 2.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collect(ann.nearest(df, df.where("vec_id % 100 = 0")))
    assert got == {0: [(1, 1.0), (100, 1.0)], 100: [(0, 1.0), (1, pytest.approx(2**0.5))]}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("clusters", [1, 40])
def test_share_of_verified_vectors_and_recall(spark, clusters):
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(20_000, 64)) + 3 * rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 20_000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("f4")
    ids = np.arange(len(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = ann.nearest(df, df.where("vec_id % 200 = 0"), 10)
    want = brute(ids, x.astype("f8"), ids[ids % 200 == 0], 10)
    assert recall(collect(rows), want) >= 0.95
    share = rows.where("rank = 1").agg({"verified": "avg"}).first()[0] / len(x)
    assert 10 / len(x) < share < (0.2 if clusters == 1 else 0.05), share


def test_lengths_are_searches_of_their_own_and_columns_may_clash(spark, monkeypatch):
    rows = [(i, [float(i), 1.0] if i % 2 else [float(i), 1.0, 2.0], 1, 2.0, 3, 4) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, cell int, part int")
    got = collect(ann.nearest(df, df.where("vec_id in (5, 6)"), 3))
    assert got == {5: [(3, 2.0), (7, 2.0), (1, 4.0)], 6: [(4, 2.0), (8, 2.0), (2, 4.0)]}
    monkeypatch.setattr(ann, "LENGTHS", 1)
    with pytest.raises(ValueError):
        ann.nearest(df, df)
