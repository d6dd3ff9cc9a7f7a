"""What a search of many requests writes and moves: neither passages for each block of queries, nor texts for each query that finds them."""

import pytest
from pyspark.sql import functions as F

from attestor import scratch
from attestor.operators import lexical as L, retrieval as R, service as S
from attestor.plans import catalog, investigation as plans


@pytest.fixture(scope="module")
def made(spark):
    words = ["red", "green", "blue", "grey", "black"]
    passages = spark.createDataFrame([(i, f"d{i}", " ".join(words[: i % 5 + 1] * (1 + i % 3)) + " filler" * 400, f"l{i}") for i in range(60)], "ref long, document_ref string, text string, locator string")
    queries = spark.createDataFrame([(q, f"{words[q % 5]} {words[q * q % 5]} q{q}") for q in range(23)] + [(99, "unheard")], "query_id long, text string")
    return scratch.cut(passages, "p"), queries


def test_blocks_of_queries_do_not_copy_passages(spark, made, monkeypatch):
    passages, queries = made
    index = L.build(passages)
    terms = L.asked(index, queries)
    want = sorted(map(tuple, L.best(index, terms, 4).collect()))
    plans, ranked = [], R.ranked
    monkeypatch.setattr(R, "ranked", lambda rows, k=None: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or ranked(rows, k))
    monkeypatch.setattr(L, "QUERY_BLOCK", 5)
    assert sorted(map(tuple, L.best(index, terms, 4).collect())) == want and len(want) == 23 * 4
    assert plans and not any("Exchange" in plan for plan in plans)


def test_texts_are_not_written_for_each_query(spark, made, monkeypatch):
    passages, queries = made
    cut, written = scratch.cut, {}
    monkeypatch.setattr(scratch, "cut", lambda df, label: written.setdefault(label, cut(df, label)))
    whole, told = S.search(passages, queries, max_candidates=3, max_extracted=1200)
    size = F.length(F.to_json(F.struct("*")))
    assert written["search-order"].agg(F.max(size)).first()[0] < R.SNIPPET + 400
    written.clear()
    few, same = S.search(passages, queries, max_candidates=3, max_extracted=1200, snippets=False)
    assert written["search-order"].agg(F.max(size)).first()[0] < 400
    rows = [sorted(map(str, d.collect())) for d in (whole.drop("snippet"), few, told, same)]
    assert rows[0] == rows[1] and len(rows[0]) == 23 * 3 and rows[2] == rows[3]
    texts = {r.ref: r.text for r in passages.collect()}
    assert all(r.snippet == texts[r.ref][: {1: 500, 2: 500, 3: 200}[r["rank"]]] for r in whole.collect())


def test_skills_are_made_where_parts_are_read(spark):
    assert "investigations" in catalog.QUERIES
    tables = plans._tables(spark, "/root/testdata/sf0.001")
    plan = tables["skills"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert tables["host"].select("skill_id").distinct().count() <= 4 and tables["skills"].count() == 200


def test_the_driver_makes_no_objects_of_queries(spark, made, monkeypatch):
    passages, queries = made
    index = L.build(passages)
    terms = L.asked(index, queries)
    want = sorted(map(tuple, L.best(index, terms, 4).collect()))
    monkeypatch.setattr(type(queries), "toPandas", None)
    assert sorted(map(tuple, L.best(index, terms, 4).collect())) == want and len(want) == 23 * 4
