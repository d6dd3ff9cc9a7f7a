"""Hand-computed and metamorphic cases of the reference-side operators."""

import ipaddress
import math

from pyspark.sql import functions as F

from attestor.functions import text as T
from attestor.operators import evidence as E
from attestor.operators import lifecycle as L
from attestor.operators import metrics as M
from attestor.operators import policy as P
from attestor.operators import research as R
from attestor.operators import retrieval as V


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens_fold_and_languages(spark):
    df = spark.createDataFrame([(1, "Straße_1 É"), (2, "Was it the reason that we did this?"), (3, "¿Por qué se hace esto para los datos?"), (4, "the"), (5, "")], "i int, t string")
    rows = {r.i: r for r in df.select("i", T.tokens(F.col("t")).alias("a"), T.terms(F.col("t")).alias("b"), T.language(F.col("t")).alias("l")).collect()}
    assert rows[1].a == ["strasse_1", "é"] and rows[1].b == ["straße", "1", "é"]
    assert [rows[i].l for i in range(1, 6)] == [None, "en", "es", None, None]


def test_casefold_and_nfc(spark):
    r = one(spark, T.casefold(F.lit("ẞΣ")), T.nfc(F.lit("é")))
    assert tuple(r) == ("ẞΣ".casefold(), "é")


def test_slug_closes_and_urls(spark):
    r = one(
        spark, T.slug(F.lit("  Fix: Über--Thing! " + "x" * 80)), T.slug(F.lit("¡¿")), T.closes(F.lit("Closes #3, fixes issue #4 and #5. Resolved: #3\nfix\n#9")),
        T.canonical_url(F.lit("HTTPS://u:p@Host.org/a/b?q=1#f")), T.canonical_url(F.lit("https://h:8443")),
    )
    assert r[0] == ("-fix-ber-thing-" + "x" * 80)[:60].strip("-") and r[1] == "untitled" and r[2] == [3, 4] and r[3] == "https://host.org:443/a/b?q=1" and r[4] == "https://h:8443/"


def test_bm25_against_the_formula(spark):
    texts = {1: "apple apple pear", 2: "pear plum", 3: "", 4: "apple"}
    p = spark.createDataFrame(list(texts.items()), "ref long, text string")
    q = spark.createDataFrame([(7, "Apple pear apple")], "query_id long, text string")
    got = {r.ref: r.score for r in V.bm25(p, q).collect()}
    n, avg = 4, 6 / 4
    docs = {k: t.split() for k, t in texts.items()}
    for k, d in docs.items():
        want = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ("apple", "pear") if (tf := d.count(t)) for df in [sum(t in x for x in docs.values())])
        assert (k in got) == (want > 0) and abs(got.get(k, 0) - want) < 1e-8
    again = {r.ref: r.score for r in V.bm25(p.repartition(3), q).collect()}
    assert again == got


def test_fusion_discounts_but_never_removes(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, ref string, rank int")
    vec = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, ref string, rank int")
    plain = {r.ref: r for r in V.fuse(lex, vec).collect()}
    assert [plain[x]["rank"] for x in "bac"] == [1, 2, 3] and plain["b"].via == "both"
    weights = spark.createDataFrame([(1, 0.1)], "query_id int, weight double")
    less = {r.ref: r for r in V.fuse(lex, vec, weights).collect()}
    assert set(less) == set(plain) and less["c"]["rank"] < less["a"]["rank"]


def test_interleave_with_a_constant_scorer_keeps_documents(spark):
    rows = [(1, f"r{i}", d, i) for i, d in enumerate("aababcc", 1)]
    ranking = spark.createDataFrame(rows, "query_id int, ref string, document_ref string, rank int")
    order = V.documents_of(ranking).select("query_id", "document_ref", F.col("rank").alias("new_rank"))
    got = [r.ref for r in V.interleave(ranking, order).orderBy("final_rank").collect()]
    assert got == ["r1", "r3", "r6", "r2", "r5", "r7", "r4"]


def test_truncation_counts_candidates_first_and_clips(spark):
    m = spark.createDataFrame([(1, i, i, "x" * n) for i, n in enumerate((600, 300, 900, 50), 1)], "query_id int, ref int, rank int, text string")
    lengths = lambda c, n: [len(r.snippet) for r in V.truncate(m, c, n).orderBy("rank").collect()]
    assert lengths(10, 1000) == [500, 300, 200] and lengths(2, 1000) == [500, 300] and lengths(10, 10_000) == [500, 300, 500, 50]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["b", "z"], ["a", "b"]), (2, ["x"], [], []), (3, ["x"], [], ["x"])], "i int, r array<string>, m array<string>, a array<string>")
    rows = {x.i: x for x in df.select("i", M.recall(F.col("r"), F.col("m"), 2).alias("recall"), M.reciprocal_rank(F.col("r"), F.col("m")).alias("mrr"), M.ndcg(F.col("r"), F.col("m"), F.col("a")).alias("ndcg")).collect()}
    ideal = 2 + 2 / math.log2(3) + 1 / 2
    assert rows[1].recall == 0.5 and rows[1].mrr == 0.5 and abs(rows[1].ndcg - (1 + 2 / math.log2(3)) / ideal) < 1e-12
    assert tuple(rows[2])[1:] == (None, None, None) and rows[3].ndcg == 1.0 and rows[3].recall is None


def test_separation_is_free_of_scale(spark):
    values = [0.9, 0.3, 0.31, 0.29, 0.35, 0.28, 0.33, 0.27, 0.3]
    df = spark.createDataFrame([(k, i, v * f) for k, f in ((1, 1.0), (2, 40.0)) for i, v in enumerate(values)] + [(3, i, 1.0) for i in range(9)] + [(4, 0, 1.0)], "q int, ref int, score double")
    s = {r.q: r.separation for r in M.separation(df, "q").collect()}
    assert abs(s[1] - s[2]) < 1e-9 and s[3] is None and s[4] is None


def test_auc_sign_test_and_shuffle_null(spark):
    df = spark.createDataFrame([(1, True, 3.0), (1, True, 1.0), (1, False, 1.0), (1, False, 0.0), (2, True, 1.0)], "q int, positive boolean, score double")
    assert {r.q: r.auc for r in M.auc(df, "q").collect()} == {1: 0.875, 2: None}
    assert M.sign_test(0, 0) == 1.0 and abs(M.sign_test(9, 1) - 22 / 1024) < 1e-12
    assert tuple(one(spark, M.expected_rank(F.lit(50), F.lit(40)), M.expected_rank(F.lit(3), F.lit(40)))) == (50.0, 20.5)


def test_risk_order_and_host_actions(spark):
    r = one(spark, P.effective_risk(F.lit("high"), F.lit("unknown")), P.effective_risk(F.lit("unknown"), F.lit("regulated")), P.host_actions(F.array(F.lit("missing_jurisdiction"), F.lit("new"), F.lit("missing_jurisdiction"))))
    assert tuple(r) == ("unknown", "regulated", ["request_jurisdiction:missing_jurisdiction"])


def test_freshness_and_jurisdiction(spark):
    d = lambda s: F.lit(s).cast("date")
    none = F.lit(None).cast("date")
    r = one(
        spark, E.freshness(d("2024-01-10"), d("2024-01-09"), none, none, F.lit(5)), E.freshness(d("2024-01-10"), none, none, none, F.lit(5)), E.freshness(d("2024-01-10"), none, none, d("2024-01-04"), F.lit(5)),
        E.freshness(d("2024-01-10"), none, d("2024-01-05"), d("2020-01-01"), F.lit(5)), E.jurisdiction_applicable(F.array(F.lit("EU")), F.lit(None).cast("string")), E.jurisdiction_applicable(F.array(F.lit("GLOBAL")), F.lit("unknown")),
    )
    assert tuple(r) == ("expired", "unknown", "stale", "current", False, True)


def test_ledger_denial_is_absorbing(spark):
    calls = spark.createDataFrame([(1, i, b, c) for i, (b, c) in enumerate([(500, False), (9999, True), (600, False), (10, False), (10, True)])], "investigation int, seq int, bytes long, cached boolean")
    assert [r.decision for r in R.ledger(calls, 10, 2000).orderBy("seq").collect()] == ["fetch", "cached", "fetch", "network_budget_exhausted", "cached"]


def test_dangerous_addresses(spark):
    ips = ["8.8.8.8", "10.0.0.1", "169.254.169.254", "::1", "224.0.0.1", "no", None, "2606:4700::1111"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ips], "ip string").select(R.dangerous_ip("ip")).collect()]
    assert got == [not (i and i != "no" and ipaddress.ip_address(i).is_global and not ipaddress.ip_address(i).is_multicast) for i in ips]


def test_reuse_treats_nulls_as_equal(spark):
    new = spark.createDataFrame([(1, None), (2, "b"), (3, "c")], "k int, v string")
    kept, made = L.reusable(new, spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), ["k", "v"])
    assert [r.k for r in kept.collect()] == [1] and sorted(r.k for r in made.collect()) == [2, 3]
