import base64
import hashlib
import json
from datetime import date

import pytest

from attestor.operators import service as S
from attestor.sources import packs

PACK = {
    "pack_id": "code", "version": "1.2.0", "reviewed_at": "2024-01-01", "expires_at": "2024-12-31", "freshness_days": 200, "min_router_version": "1.0.0", "max_router_version": "2.0.0",
    "domains": ["programming", "general"], "jurisdictions": ["GLOBAL"], "sources": [{"source_id": "docs", "jurisdictions": ["GLOBAL"], "freshness_days": 100}], "capabilities": [],
}
NOW = {"today": date(2024, 3, 1), "router": "1.5.0", "unsigned": True}


def test_investigate_abstains_before_it_retrieves(spark):
    requests = spark.createDataFrame(
        [("a", "note 7 budget window", None, None, None, "low"), ("b", "please install note 7", None, None, None, "low"), ("c", "the doctor's note", None, None, None, "low"), ("d", "quite elsewhere zzz", None, None, None, "low"), ("e", " ", None, None, None, "low"), ("f", "x " * 3000, None, None, None, "low")],
        "request_id string, task string, outcome string, jurisdiction string, as_of date, declared_risk string",
    )
    results, evidence = S.investigate(requests, S.synthetic_notes(spark, 40), *packs.registry(spark, [PACK]), max_evidence=5)
    r = {x.request_id: x for x in results.collect()}
    assert [r[k].status for k in "abcdef"] == ["complete", "route_only", "abstained", "partial", "error", "error"]
    assert all(x.claims == [] for x in r.values()) and r["c"].gaps == ["no_approved_domain_pack"]
    e = evidence.collect()
    assert {x.request_id for x in e} == {"a"} and len(e) == 5 and any(x.ref.startswith("7-") for x in e)


def test_read_in_order_under_a_total(spark):
    passages = spark.createDataFrame([("p", "0123456789"), ("q", "abcdefghij"), ("skill:x", "body")], "ref string, text string")
    wanted = spark.createDataFrame([(1, 1, "p", 3, 8), (1, 2, "none", None, None), (1, 3, "q", None, None), (1, 4, "skill:x", 9, 9), (1, 5, "skill:x", None, None)], "request_id int, ordinal int, ref string, start int, end int")
    rows = S.read(wanted, passages, most=12, item=7).orderBy("ordinal").collect()
    assert [(r.text, r.error, r.truncated, r.kind) for r in rows] == [("234567", None, False, "local"), (None, "unknown_ref", False, "local"), ("abcdef", None, True, "local"), (None, "invalid_range", False, "skill"), ("", None, True, "skill")]
    v = spark.createDataFrame([(1, ["a", "b"], ["a"]), (2, ["a", "a"], []), (3, ["a"], ["b"]), (4, [], [])], "request_id int, refs array<string>, range_refs array<string>")
    assert [r.valid for r in S.valid_reads(v).orderBy("request_id").collect()] == [True, False, False, False]


def test_rerank_changes_order_never_membership_and_says_why_not(spark):
    ranking = spark.createDataFrame([(q, f"d{i}", i) for q in (1, 2, 3) for i in range(1, 6)], "query_id int, document_ref string, rank int")
    texts = spark.createDataFrame([(f"d{i}", "x" * i) for i in range(1, 6)], "document_ref string, text string")
    queries = spark.createDataFrame([(1, "long"), (2, "fail"), (3, "nan")], "query_id int, text string")

    def scorer(query, docs):
        if query == "fail":
            raise RuntimeError
        return [float("nan") if query == "nan" else len(d) for d in docs]

    rows = S.rerank(ranking, texts, queries, scorer, depth=4).collect()
    order = {q: [r.document_ref for r in sorted(rows, key=lambda r: r.new_rank) if r.query_id == q] for q in (1, 2, 3)}
    assert order == {1: ["d4", "d3", "d2", "d1"], 2: ["d1", "d2", "d3", "d4"], 3: ["d1", "d2", "d3", "d4"]}
    assert {r.query_id: r.note for r in rows} == {1: "reranked:4", 2: "rerank_failed:error", 3: "rerank_failed:score"}


def test_cursor_is_canonical_json(spark):
    r = S.cursor(spark.createDataFrame([("x??>", 1)], "b string, a int")).first()
    body = json.dumps({"a": 1, "b": "x??>"}, separators=(",", ":"))
    assert base64.urlsafe_b64decode(r.cursor) == body.encode() and r.request_hash == "sha256:" + hashlib.sha256(body.encode()).hexdigest()


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({}, None), ({"extra": 1}, "malformed_pack"), ({"sources": []}, "malformed_pack"), ({"reviewed_at": "2024-03-02"}, "future_review"), ({"expires_at": "2024-02-01"}, "expired_pack"), ({"freshness_days": 100, "reviewed_at": "2023-10-01"}, "stale_pack"),
        ({"max_router_version": "1.4.9"}, "incompatible_pack"), ({"version": "1.1.9"}, "version_rollback"), ({"domains": ["law"]}, "domain_not_covered"),
    ],
)
def test_pack_checks(change, code):
    raw = json.dumps(PACK | change).encode()
    run = lambda: packs.load(raw, **NOW, floors={"code": "1.2.0"}, domain="programming")
    if code is None:
        assert run()["pack_id"] == "code"
    else:
        with pytest.raises(packs.PackError, match=code):
            run()


def test_pack_syntax_and_signatures(spark):
    for raw, code in ((b'{"a":1,"a":2}', "duplicate_key"), (b"[]", "malformed_pack"), (b"x" * 70_000, "pack_too_large"), (b'{"a":NaN}', "malformed_pack")):
        with pytest.raises(packs.PackError, match=code):
            packs.parse(raw)
    # RFC 8032, test 2
    public = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    good = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert packs.verify(public, b"\x72", good) and not packs.verify(public, b"\x73", good)
    with pytest.raises(packs.PackError, match="signature_required"):
        packs.load(json.dumps(PACK).encode(), today=NOW["today"], router="1.5.0")
    with pytest.raises(packs.PackError, match="registry_collision"):
        packs.registry(spark, [PACK, PACK])
