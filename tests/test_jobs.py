import hashlib
import json
import math
import subprocess
import sys
from pathlib import Path

import pytest

from attestor import scratch
from attestor.operators import lexical as L, metrics as M
from jobs import passage_store, registered, retrieval_report
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"
ROOT = Path(passage_store.__file__).parent.parent
SCHEMA = "doc_id long, text string, source string, batch string"


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_job_equals_its_sql(spark, name):
    assert compare(spark, database(SF), name, registered.QUERIES[name], registered.ORACLES[name], SF)


def deliver(spark, folder, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(spark, output):
    docs, parts = passage_store.current(spark, output)
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: (r.document_ref, r.ordinal)):
        texts[r.document_ref] = texts.get(r.document_ref, "") + r.text
        assert r.stop - r.start + 1 == len(r.text) and r.start == 10 * r.ordinal + 1
    return {(d.doc_id, d.source): texts.get(d.document_ref, "") for d in docs.collect()}


def test_store_over_growing_input(spark):
    root = scratch.new_path(spark, "grow")
    deliver(spark, f"{root}/in", [(1, "first text of one", "a"), (2, None, "a"), (3, "ü" * 25, None), (4, "", "b"), (None, "no id", "b"), (1, "first text of one", "a")])
    done = passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10)
    assert (done["rows"], done["documents"], done["batches"]) == (6, 5, 1)
    want = {(1, "a"): "first text of one", (2, "a"): "", (3, "unknown"): "ü" * 25, (4, "b"): "", (None, "b"): "no id"}
    assert state(spark, f"{root}/out") == want
    assert passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10)["rows"] == 0

    # what is delivered again is left out, another text is a new version, and so is the old one after it
    deliver(spark, f"{root}/in", [(1, "second text", "a"), (3, "ü" * 25, None), (5, "new", "a"), (None, "no id", "b"), (1, "text elsewhere", "b")])
    done = passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10)
    assert (done["rows"], done["documents"]) == (5, 3)
    want |= {(1, "a"): "second text", (5, "a"): "new", (1, "b"): "text elsewhere"}
    assert state(spark, f"{root}/out") == want
    deliver(spark, f"{root}/in", [(1, "first text of one", "a")])
    assert passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10)["documents"] == 1
    assert state(spark, f"{root}/out") == want | {(1, "a"): "first text of one"}
    versions = spark.read.parquet(f"{root}/out/documents")
    assert versions.count() == 9 and versions.where("doc_id = 1 AND source = 'a'").count() == 3


def test_one_run_equals_many_and_a_failed_batch_leaves_no_trace(spark, monkeypatch):
    root = scratch.new_path(spark, "fail")
    for i in range(4):
        deliver(spark, f"{root}/in", [(k, f"text {k} of {i % 3}", "ab"[k % 2]) for k in range(i, i + 6)])
    made = passage_store.passages

    def broken(rows, n):
        raise RuntimeError("lost")

    monkeypatch.setattr(passage_store, "passages", broken)
    with pytest.raises(Exception, match="lost"):  # documents of the first batch are written, passages aren't
        passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10, files_per_batch=1)
    assert spark.read.parquet(f"{root}/out/documents").count() == 6
    monkeypatch.setattr(passage_store, "passages", made)
    assert passage_store.run(spark, f"{root}/in", f"{root}/out", passage_characters=10, files_per_batch=1)["batches"] == 4
    assert passage_store.run(spark, f"{root}/in", f"{root}/whole", passage_characters=10)["batches"] == 1
    assert state(spark, f"{root}/out") == state(spark, f"{root}/whole") and len(state(spark, f"{root}/out")) == 9


def test_store_of_nothing(spark):
    root = scratch.new_path(spark, "none")
    deliver(spark, f"{root}/in", [])
    assert passage_store.run(spark, f"{root}/in", f"{root}/out")["documents"] == 0
    assert all(t.count() == 0 for t in passage_store.current(spark, f"{root}/out"))


def test_references_follow_the_text(spark):
    root = scratch.new_path(spark, "refs")
    deliver(spark, f"{root}/in", [(7, "some words", "s")])
    passage_store.run(spark, f"{root}/in", f"{root}/out")
    (doc,), (part,) = (t.collect() for t in passage_store.current(spark, f"{root}/out"))
    assert doc.document_ref == "doc:v1:" + hashlib.sha256(b"s/7.md").hexdigest() and doc.source_hash == hashlib.sha256(b"some words").hexdigest()
    assert part.ref == "chunk:v1:" + hashlib.sha256(f"{doc.document_ref}\0{doc.source_hash}\0000".encode()).hexdigest()


def test_report_by_hand_reruns_and_labels(spark):
    root = scratch.new_path(spark, "report")
    docs = [(1, "alpha beta gamma delta"), (2, "gamma beta alpha"), (3, "beta beta alpha gamma delta epsilon"), (4, None), (5, "zeta zeta"), (6, "xalpha betax")]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int").write.parquet(f"{root}/docs")
    asked = [(10, "beta gamma delta"), (11, "alpha beta gamma"), (12, "nothing here"), (13, None), (14, ""), (15, "alpha beta"), (16, "zeta")]
    spark.createDataFrame([(*q, "x") for q in asked], "item_id long, text string, ref string").write.parquet(f"{root}/asked")
    run = lambda label: retrieval_report.run(spark, f"{root}/docs", f"{root}/asked", f"{root}/out", label, 2)
    assert run("a")["questions_written"] == 7
    rows, sums = retrieval_report.report(spark, f"{root}/out")
    got = {r.item_id: r for r in rows.collect()}
    truth = {q: {d for d, t in docs if s and t and s in t} for q, s in asked}
    assert truth[15] == {1, 6} and truth[10] == {1}
    for q, r in got.items():
        hits = [i + 1 for i, d in enumerate(r.ranked) if d in truth[q]]
        assert (r.must, r.found, r.first_rank) == (len(truth[q]), len(hits), min(hits, default=None)), q
        assert r.recall_at_k == (round(len(hits) / len(truth[q]), 6) if truth[q] else None)
        assert r.mrr == ((round(1 / min(hits), 6) if hits else 0.0) if truth[q] else None)
    assert got[16].acceptable == 0 and got[16].must == 1 and got[16].ndcg == 1.0  # what must be found isn't merely acceptable
    before, total = sorted(map(str, rows.collect())), sums.where("by = 'all'").first()
    run("b")
    assert run("a") and sorted(map(str, retrieval_report.report(spark, f"{root}/out")[0].where("run = 'a'").collect())) == before
    assert {r.run for r in retrieval_report.report(spark, f"{root}/out")[1].select("run").distinct().collect()} == {"a", "b"}
    assert (total.questions, total.answered) == (7, sum(bool(t) for t in truth.values()))


def test_judge_equals_the_measures_over_arrays(spark):
    ranking = [(q, (q * 7 + i * 3) % 20, i + 1) for q in range(30) for i in range(10) if q % 9 or i < 3]
    relevance = [(q, r, 1 + (q + r) % 2) for q in range(30) for r in range(q % 12)] + [(4, 1, 1), (4, 1, 2)]
    queries = spark.range(31).withColumnRenamed("id", "query_id")
    told = M.judge(queries, spark.createDataFrame(ranking, "query_id long, ref long, rank int"), spark.createDataFrame(relevance, "query_id long, ref long, gain int"), 5)
    arrays = []
    for q in range(31):
        best = {}
        for a, r, g in relevance:
            if a == q:
                best[r] = max(g, best.get(r, 0))
        arrays.append((q, [r for a, r, _ in ranking if a == q], [r for r, g in best.items() if g == 2], [r for r, g in best.items() if g == 1]))
    df = spark.createDataFrame(arrays, "query_id long, r array<long>, must array<long>, ok array<long>")
    want = {x[0]: tuple(x[1:]) for x in df.select("query_id", M.recall(df.r, df.must, 3), M.recall(df.r, df.must, 5), M.reciprocal_rank(df.r, df.must, 5), M.ndcg(df.r, df.must, df.ok, 5), M.diversity(df.r, 5)).collect()}
    for x in told.collect():
        for a, b in zip((x.recall_at_3, x.recall_at_k, x.mrr, x.ndcg, x.diversity), want[x.query_id], strict=True):
            assert a == b or math.isclose(a, b), (x, want[x.query_id])


def test_passages_that_hold_an_item(spark):
    texts = ["a concatenate b", "cat", "the cat sat on the mat", "scat dogma", None, "...", "wait... what", "cat  dog"]
    items = ["cat", "the cat sat", "cat dog", "...", "", None, "cat dogm", "on the mat", "sat on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "ref long, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    got = {(r.query_id, r.ref) for r in L.holding(L.build(docs), docs, asked).collect()}
    assert got == {(q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i and t and i in t}


def test_command_line(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "x.parquet").write_bytes(Path(f"{SF}/documents.parquet").read_bytes())
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": str(source), "passage_characters": 500}))
    command = [sys.executable, "-m", "jobs.passage_store", "--config", str(config), "--output", str(tmp_path / "out")]
    for _ in range(2):
        done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
    assert '"rows": 0' in done.stderr and (tmp_path / "out/passages").is_dir()
    config.write_text(json.dumps({"unheard": 1}))
    assert subprocess.run(command, cwd=ROOT, capture_output=True, timeout=300).returncode == 2
