"""Reading from four stores: one call, calls chained by cursors, and all calls of a chain at once."""

import pytest
from pyspark.sql import functions as F

from attestor.operators import reading as R

WANTED = "request_id string, ordinal int, ref string, start int, end int"


@pytest.fixture(scope="module")
def store(spark):
    local = [("p", "0123456789"), ("q", "abcdefghij" * 5), ("twice", "one"), ("twice", "two"), ("void", ""), ("none", None), ("skill:s@1", "not a skill"), ("🙂", "🙂é🙂é🙂é🙂")]
    local = spark.createDataFrame([(r, t, "l", r + "#1", "d") for r, t in local], "ref string, text string, locator string, citation string, digest string")
    skills = spark.createDataFrame([("s", "2", None, "d2", "k/s.md")], "skill_id string, version string, summary string, digest string, locator string")
    capabilities = spark.createDataFrame([("c", "1", "d3", "pkg:c")], "capability_id string, version string, digest string, locator string")
    live = [("live:a", "old", "2024-01-01", "2024-03-01"), ("live:a", "new page", "2024-01-02", "2024-03-01"), ("live:b", "gone", "2024-01-01", "2024-01-05"), ("live:c", "x", "2024-01-01", None), ("live:c", "y", "2024-01-01", None)]
    live = spark.createDataFrame([(r, t, "u", "c", "d", w, e) for r, t, w, e in live], "ref string, excerpt string, locator string, citation string, digest string, written_at string, expires_at string")
    live = live.withColumn("written_at", F.col("written_at").cast("timestamp")).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return R.stores(local, skills, capabilities, live, F.lit("2024-02-01").cast("timestamp")).cache()


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), WANTED)


def by_ordinal(items):
    return {(r.request_id, r.ordinal): r for r in items.collect()}


def test_each_store_answers_its_own_references(spark, store):
    refs = ["p", "skill:s@2", "skill:s@1", "capability:c", "live:a", "live:b", "live:c", "twice", "void", "none"]
    items, ended = R.read(ask(spark, *(("r", i, ref, None, None) for i, ref in enumerate(refs))), store, most=10_000, item=5000)
    found = by_ordinal(items)
    assert [found["r", i].status for i in range(10)] == ["ok", "ok", "missing_ref", "ok", "ok", "expired_ref", "ambiguous_ref", "ambiguous_ref", "invalid_range", "missing_ref"]
    assert found["r", 1].text == '{"digest":"d2","locator":"k/s.md","skill_id":"s","summary":null,"version":"2"}' and found["r", 1].citation == "s@2"
    assert found["r", 4].text == "new page" and found["r", 5].text is None and found["r", 3].kind == "capability"
    assert [tuple(r)[1:4] for r in ended.collect()] == [(None, sum(len(r.text) for r in found.values() if r.text), None)]


def test_refused_requests_read_nothing(spark, store):
    many = [("many", i, "p", None, None) for i in range(11)]
    rows = [*many, ("tie", 1, "p", None, None), ("tie", 1, "q", None, None), ("null", None, "p", None, None), (None, 1, "p", None, None), ("good", 1, None, None, None), ("good", 2, "p", 4, 2), ("good", 3, "p", 9, 99), ("good", 4, "p", 0, 3)]
    items, ended = R.read(ask(spark, *rows), store, most=100, item=100)
    status = {(r.request_id, r.ordinal): (r.status, r.text) for r in items.collect()}
    assert all(v == ("invalid_request", None) for k, v in status.items() if k[0] != "good") and items.count() == len(rows)
    assert [status["good", i] for i in (1, 2, 3, 4)] == [("missing_ref", None), ("invalid_range", None), ("ok", "89"), ("invalid_range", None)]
    assert [r.request_id for r in ended.collect()] == ["good"]
    assert R.chain(ask(spark, *rows), store, most=3).where("status = 'invalid_request'").count() == len(rows) - 4
    none = ask(spark)
    assert R.read(none, store, most=1, item=1)[0].count() == 0 and R.chain(none, store, most=1).count() == 0


@pytest.mark.parametrize(("most", "item", "total"), [(7, 7, 1000), (9, 4, 1000), (20, 6, 33)])
def test_chained_calls_return_every_character_once(spark, store, most, item, total):
    wanted = ask(spark, ("a", 1, "p", None, None), ("a", 2, "q", 3, 31), ("a", 3, "🙂", None, None), ("a", 4, "nowhere", None, None), ("b", 1, "q", None, None), ("c", 1, "p", 2, 4))
    whole, _ = R.read(wanted, store, most=10**6, item=10**6)
    items, ended = R.read(wanted, store, most=most, item=item, total=total)
    pieces, spent, calls = [], {}, 0
    while calls < 60:
        calls += 1
        call = items.collect()
        for request in {r.request_id for r in call}:
            got = sum(len(r.text or "") for r in call if r.request_id == request)
            assert got <= most
            spent[request] = spent.get(request, 0) + got
        assert all(len(r.text or "") <= item for r in call)
        pieces += [r for r in call if r.status == "ok"]
        cursors = ended.collect()
        if not any(r.cursor for r in cursors):
            break
        # a cursor travels as text
        items, ended = R.read(wanted, store, most=most, item=item, total=total, cursors=spark.createDataFrame([(r.request_id, r.cursor) for r in cursors], "request_id string, cursor string"))
    for key, r in by_ordinal(whole).items():
        mine = sorted((p for p in pieces if (p.request_id, p.ordinal) == key), key=lambda p: p.first)
        text = "".join(p.text for p in mine)
        assert all(x.last + 1 == y.first or not y.text for x, y in zip(mine, mine[1:], strict=False))
        assert (r.text or "").startswith(text) and (total < 100 or text == (r.text or ""))
    assert all(v <= total for v in spent.values()) and (total > 100 or spent["b"] == total)
    if item >= most:  # all calls at once are those calls
        at_once = sorted((r.request_id, r.ordinal, r.first, r.text) for r in R.chain(wanted, store, most=most).where("status = 'ok'").collect())
        assert at_once == sorted((p.request_id, p.ordinal, p.first, p.text) for p in pieces if p.text)


def test_cursors_of_others_are_refused(spark, store):
    wanted = ask(spark, ("a", 1, "q", None, None), ("b", 1, "q", 2, None), ("c", 1, "q", None, None), ("d", 1, "q", None, None))
    _, ended = R.read(wanted, store, most=5, item=5)
    cursor = {r.request_id: r.cursor for r in ended.collect()}
    given = spark.createDataFrame([("a", cursor["b"]), ("b", "no cursor!"), ("c", cursor["c"]), ("d", None)], "request_id string, cursor string")
    items, _ = R.read(wanted, store, most=5, item=5, cursors=given)
    assert {(r.request_id, r.status, r.text) for r in items.collect()} == {("a", "invalid_cursor", None), ("b", "invalid_cursor", None), ("c", "ok", "fghij")}


def test_a_very_long_text_of_mixed_widths(spark):
    text = "a🙂" * 100_000
    local = spark.createDataFrame([("x", text, "l", "c", "d")], "ref string, text string, locator string, citation string, digest string")
    rows = R.chain(ask(spark, ("r", 1, "x", 2, None)), R.stores(local), most=30_000).orderBy("call").collect()
    assert "".join(r.text for r in rows) == text[1:] and [r.first for r in rows] == [2 + 30_000 * i for i in range(7)]
