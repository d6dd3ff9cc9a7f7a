"""What grows with the input: rows that a plan makes must not be pairs of its inputs."""

from pyspark.sql import functions as F

from attestor.operators import context as C, lexical as L, retrieval as R, service
from attestor.operators import skills as S
from attestor.plans import evaluation, retrieval as plans, service as calls
from attestor.plans.policy import _registry

SF = "/root/testdata/sf0.001"


def rows_made(spark, df):
    """Rows of the result, and the most rows that a node of the executed plan made."""
    out = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    run = store.executionsCount() - 1
    last = store.executionsList().apply(int(run)).executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            if metrics.apply(j).name() == "number of output rows" and values.contains(metrics.apply(j).accumulatorId()):
                most = max(most, int(str(values.apply(metrics.apply(j).accumulatorId())).replace(",", "")))
    return out, most


def test_skills_are_counted_before_they_meet_requests(spark):
    classified = spark.range(300).select(F.col("id").cast("string").alias("request_id"), F.element_at(F.array(F.lit("law"), F.lit("general"), F.lit("none")), (F.col("id") % 3 + 1).cast("int")).alias("domain"))
    listed = F.when(F.col("id") % 2 == 0, F.array(F.lit("law"), F.lit("law"))).otherwise(F.array(F.lit("law"), F.lit("general")))
    skills = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 390).alias("skill_id"), F.lit("p").alias("pack_id"), listed.alias("domains"))
    want = S.matched(classified, skills).groupBy("request_id").agg(F.count("*").alias("skills"), F.min("skill_id").alias("first"))
    got, most = rows_made(spark, S.match_counts(classified, skills))
    expected, pairs = rows_made(spark, want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, expected)) and len(got) == 200
    assert most <= 1000 < 40_000 <= pairs


def test_context_is_assembled_without_broadcasts(spark):
    ids = spark.range(40).select(F.col("id").alias("request_id"))
    requests = ids.withColumns({"outcome": F.lit("proceed"), "reason": F.lit(None).cast("string"), "route_gaps": F.array(F.lit("routed"))})
    none = F.array().cast("array<string>")
    told = ids.select("request_id", F.lit(1).alias("seq"), F.lit("c").alias("claim_text"), F.lit("supported").alias("state"), F.array(F.lit("e1")).alias("supporting_refs"), none.alias("conflicting_refs"), none.alias("other_refs"), none.alias("conflict_classes"), none.alias("uncertainty"))
    pool = ids.where("request_id <> 7").select("request_id", F.explode(F.array(F.lit("e1"), F.lit("e1"))).alias("ref"))
    research = ids.limit(0).select("request_id", F.lit(1).alias("seq"), F.lit("fetched").alias("status"), F.lit("x").alias("code"), F.lit("r").alias("ref"))
    out = C.assemble(requests, told, pool, research)
    assert {(r.request_id, r.status) for r in out.collect()} == {(i, "abstained" if i == 7 else "complete") for i in range(40)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_statuses_need_no_scores(spark, monkeypatch):
    rows = [("a", "legal contract alpha"), ("b", "legal contract"), ("c", ""), ("d", "install alpha"), ("e", "diagnosis"), ("f", "general beta"), ("g", "nothing held"), ("h", "alpha " * 1000)]
    requests = spark.createDataFrame([(i, t, None, "EU", "low") for i, t in rows], "request_id string, task string, outcome string, jurisdiction string, declared_risk string").withColumn("as_of", F.lit("2024-01-01").cast("date"))
    passages = spark.createDataFrame([(1, "Alpha", "x"), (2, "BETA beta", "y"), (3, None, "z")], "ref int, text string, locator string")
    index = L.build(passages)
    want = {(r.request_id, r.status) for r in service.investigate(requests, passages, *_registry(spark), index=index)[0].collect()}
    assert {s for _, s in want} == {"complete", "partial", "error", "route_only", "abstained"}
    monkeypatch.setattr(L, "top", None)
    assert {tuple(r) for r in service.statuses(requests, *_registry(spark), index).collect()} == want
    assert calls.investigation_status(spark, SF).count()


def test_rankings_leave_tasks_as_heads(spark, monkeypatch):
    asked = []
    whole = R.cosine
    monkeypatch.setattr(R, "cosine", lambda p, q, k=None, **more: asked.append(k) or whole(p, q, k, **more))
    lists = {r.query_id: r.ranked for r in evaluation._lists(spark, SF).collect()}
    assert asked == [21]
    every = R.ranked(plans.vectors(spark, SF).where("query_id <> ref"), 20).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "ref"))).alias("r"))
    assert lists == {r.query_id: [x.ref for x in r.r] for r in every.collect()}


def test_leg_notes_need_no_scores(spark, monkeypatch):
    passages = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, None), (5, [float("nan"), 1.0])], "ref long, vector array<double>")
    queries = spark.createDataFrame([(1, [0.0, 2.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0])], "query_id long, vector array<double>")
    found = {r.query_id for r in R.cosine(passages, queries).collect()}
    assert found == {1, 2} == {r.query_id for r in R.comparable(passages, queries).collect()}
    monkeypatch.setattr(R, "cosine", None)
    monkeypatch.setattr(L, "scores", None)
    assert plans.leg_notes(spark, SF).count()
