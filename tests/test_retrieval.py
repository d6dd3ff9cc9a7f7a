import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestor import scratch
from attestor.functions import text as T
from attestor.operators import fusion, lexical as L, policy as P, retrieval as R, service as S


def corpus(seed, n=400):
    """Common words everywhere, rare ones here and there, empty and repeated texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "w0 " * 500)]


def by_hand(docs, query, k):
    tokens = {d: (t or "").lower().split() for d, t in docs}
    n, avgdl = len(docs), sum(map(len, tokens.values())) / len(docs)
    out = []
    for d, t in tokens.items():
        tf, score = Counter(t), 0.0
        for q in set(query.split()) & set(t):
            df = sum(q in x for x in tokens.values())
            score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(t) / avgdl))
        if score:
            out.append((-round(score, 9), d))
    return [d for _, d in sorted(out)[:k]]


@pytest.mark.parametrize("spared,dense", [(0.0, 0), (0.75, 0), (1.1, 0), (0.75, 10**9)])
def test_top_is_exact_whatever_is_spared(spark, monkeypatch, spared, dense):
    monkeypatch.setattr(L, "SPARED", spared)
    monkeypatch.setattr(L, "DENSE", dense)
    monkeypatch.setattr(L, "SEED", 3)
    docs = corpus(1)
    index = L.build(spark.createDataFrame(docs, "ref int, text string"))
    assert index.n == len(docs)
    rng = random.Random(2)
    queries = [(i, " ".join({f"w{int(300 * rng.random() ** 2)}" for _ in range(rng.randrange(1, 9))}) + " w0 w1") for i in range(25)] + [(99, "unheard of"), (100, "")]
    got = {}
    for r in L.top(index, spark.createDataFrame(queries, "query_id int, text string"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ref)
    assert {q: by_hand(docs, t, 5) for q, t in queries if by_hand(docs, t, 5)} == got


def test_an_index_is_built_again_when_its_files_change(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    spark.createDataFrame([(1, "a b")], "ref int, text string").write.parquet(path)
    assert L.opened(spark, path, "ref", "text") is L.opened(spark, path, "ref", "text")
    spark.createDataFrame([(2, "c")], "ref int, text string").write.mode("append").parquet(path)
    assert L.opened(spark, path, "ref", "text").n == 2


def vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8 if i % 9 else 4)]) for i in range(200)] + [(500, None), (501, [0.0] * 8), (502, [float("nan")] * 8)]
    return spark.createDataFrame(rows, "ref int, vector array<double>"), rows


def test_blocked_cosine_equals_pairs(spark):
    p, rows = vectors(spark)
    q = p.where("ref % 7 = 0").withColumnRenamed("ref", "query_id")
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows[:200]}
    want = {(a, b): sum(x * y for x, y in zip(unit[a], unit[b])) for a in unit if a % 7 == 0 for b in unit if len(unit[a]) == len(unit[b])}
    for block in (4096, 5):
        got = {(r.query_id, r.ref): r.score for r in R.cosine(p, q, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
        best = {(r.query_id, r["rank"]): r.ref for r in R.ranked(R.cosine(p, q, 3, block=block), 3).collect()}
        assert best == {(r.query_id, r["rank"]): r.ref for r in R.ranked(R.cosine(p, q, block=block), 3).collect()}


def hybrid(spark, n, seed, with_vectors=0.9, width=6):
    """Passages with common and rare words, copies among them, and queries of the same kind; some lack a vector."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 12)))
    vector = lambda: [rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(width)] if rng.random() < with_vectors else None
    rows = [(i, f"d{i // 3}", text(), f"l{i}", vector()) for i in range(n)]
    rows += [(n + i, f"c{i}", *rows[7][2:]) for i in range(n // 3)]  # a third has equal texts and vectors
    queries = [(q, text() if q else "nothing that occurs", vector()) for q in range(9)]
    p = spark.createDataFrame(rows, "ref long, document_ref string, text string, locator string, vector array<double>").repartition(5)
    return p, spark.createDataFrame(queries, "query_id long, text string, vector array<double>")


COLUMNS = ["query_id", "rank", "ref", "lexical_rank", "vector_rank", "score"]


def whole(index, p, q, weights):
    return R.fuse(R.ranked(L.scores(index, q)), R.ranked(R.cosine(p, q.where("vector IS NOT NULL"))), weights)


@pytest.mark.parametrize("n,k,vectors", [(900, 5, 0.9), (900, 2, 0.01), (40, 30, 0.9), (300, 10, 0.0)])
def test_fusion_by_thresholds_equals_fusion_of_whole_rankings(spark, n, k, vectors):
    p, q = hybrid(spark, n, n + k, vectors)
    index, weights = L.build(p), q.select("query_id", F.when(F.col("query_id") % 2 == 0, 1.0).otherwise(0.1).alias("weight"))
    want = whole(index, p, q, weights).where(F.col("rank") <= k).select(COLUMNS).collect()
    got = fusion.fused(index, p, q, weights, k).select(COLUMNS).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    also = [(1, 3), (2, n - 1), (2, 5), (3, n + 1), (0, 0)]
    more = fusion.fused(index, p, q, weights, k, also=spark.createDataFrame(also, "query_id long, ref long")).collect()
    exact = {(r.query_id, r.ref): (r.lexical_rank, r.vector_rank, r.score) for r in whole(index, p, q, weights).collect()}
    told = {(r.query_id, r.ref): (r.lexical_rank, r.vector_rank, r.score) for r in more}
    assert {k: exact[k] for k in also if k in exact} == {k: told[k] for k in also if k in told}


def test_fusion_writes_heads_only(spark, monkeypatch):
    """Rows written grow with queries, not with passages."""
    written = []
    cut = scratch.cut

    def counted(df, label):
        out = cut(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(scratch, "cut", counted)
    for n in (1500, 6000):
        p, q = hybrid(spark, n, 3)
        index = L.build(p)
        written.clear()
        fusion.fused(index, p, q, q.select("query_id", F.lit(1.0).alias("weight")), 5).collect()
        most, terms = 9 * 2 * fusion.reach(5), 12
        assert all(rows <= most * (terms if "lookup" in label else 1) for label, rows in written if label != "candidates"), written


def test_search_with_a_scorer_equals_whole_rankings(spark):
    p, q = hybrid(spark, 400, 11)
    scorer = lambda query, docs: [float(len(d) % 7) for d in docs]
    got = S.search(p, q, corpus_language=None, max_candidates=30, max_extracted=10**6, scorer=scorer)[0].select("query_id", "rank", "ref").collect()
    index = L.build(p)
    order = whole(index, p, q, q.select("query_id", F.lit(1.0).alias("weight"))).join(p.select("ref", "document_ref"), "ref")
    asked = q.where("text <> ''")
    reranked = S.rerank(R.documents_of(order), S.document_texts(p), asked, scorer)
    want = R.interleave(order.join(asked.select("query_id"), "query_id"), reranked.select("query_id", "document_ref", "new_rank")).where("final_rank <= 30").select("query_id", F.col("final_rank").alias("rank"), "ref").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_folding_and_normal_forms(spark):
    texts = ["STRASSE Straße", "ΟΔΟΣ οδός", "ﬁle ﬂow ﬅop", "plain ASCII", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t")).alias("x"), "t").collect()
    for r in rows:
        assert r.x == (None if r.t is None else r.t.casefold().split())
    requests = spark.createDataFrame([(1, "auditoría externa", None, None), (2, "auditoría externa", None, None)], "request_id int, task string, outcome string, jurisdiction string")
    a, b = P.classify(requests).orderBy("request_id").collect()
    assert a.domain == b.domain != "general"


def test_search_with_rerank_budgets_and_missing_vectors(spark):
    passages = spark.createDataFrame([(f"d{i}-{j}", f"d{i}", f"word{i} common text {j}", f"l{i}", [1.0, float(i)]) for i in range(6) for j in range(2)], "ref string, document_ref string, text string, locator string, vector array<double>")
    queries = spark.createDataFrame([(1, "common word3", [1.0, 3.0]), (2, "common", None), (3, " ", None), (4, "absent", None)], "query_id int, text string, vector array<double>")
    matches, outcomes = S.search(passages, queries, corpus_language="en", max_candidates=5, max_extracted=40, scorer=lambda q, docs: [1.0 if "word5" in d else 0.0 for d in docs])
    rows = {}
    for r in matches.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append(r)
    told = {r.query_id: r for r in outcomes.collect()}
    assert rows[1][0].document_ref == rows[2][0].document_ref == "d5" and sum(len(r.snippet) for r in rows[1]) == 40
    assert told[1].truncated and "reranked:6" in told[1].notes and "max_extracted_chars_exceeded" in told[1].notes
    assert "vector_leg_unavailable" in told[2].notes and told[3].status == "error" and told[3].notes == ["empty_query"]
    assert told[4].warnings == ["no_eligible_results"] and told[4].status == "partial"
