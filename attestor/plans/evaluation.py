"""Evaluation over the driver's tables: vectors of a label are each other's truth, orders stand for rerank outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.operators import metrics as M
from attestor.operators import retrieval as R, spread
from attestor.plans.catalog import query, read
from attestor.plans.retrieval import COSINE_SQL, compared, vectors


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query vector: its ranking of 20 (itself left out), the truth (first three of its label by id) and what is acceptable (the next five)."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), "label")
    top = R.ranked(vectors(spark, sf_dir, k=21).where("query_id <> ref"), 20)  # one more than the ranking, as a query may be among its own best
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref"))).alias("r")).select("query_id", F.col("r.ref").alias("ranked"))
    from pyspark.sql import Window

    first = rows.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("ref"))).where("i <= 8")
    truth = first.groupBy("label").agg(F.array_sort(F.collect_list(F.when(F.col("i") <= 3, F.col("ref")))).alias("must"), F.array_sort(F.collect_list(F.when(F.col("i") > 3, F.col("ref")))).alias("acceptable"))
    asked = rows.where("ref % 50 = 0").select(F.col("ref").alias("query_id"), "label")
    return asked.join(lists, "query_id").join(truth, "label")


_LISTS = f"""{COSINE_SQL},
    top AS (SELECT query_id, ref, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM cs WHERE query_id <> ref),
    tr AS (SELECT label, ref, row_number() OVER (PARTITION BY label ORDER BY ref) AS i FROM e),
    asked AS (SELECT ref AS query_id, label FROM e WHERE ref % 50 = 0),
    rel AS (SELECT a.query_id, a.label, t.ref, CASE WHEN i <= 3 THEN 2 ELSE 1 END AS g FROM asked a JOIN tr t USING (label) WHERE i <= 8),
    got AS (SELECT r.*, t.rank FROM rel r LEFT JOIN (SELECT * FROM top WHERE rank <= 20) t USING (query_id, ref)),
    per AS (SELECT query_id, label, count(*) FILTER (g = 2 AND rank <= 3) / count(*) FILTER (g = 2) AS r3, count(*) FILTER (g = 2 AND rank <= 10) / count(*) FILTER (g = 2) AS r10,
                   coalesce(1.0 / min(rank) FILTER (g = 2 AND rank <= 10), 0) AS mrr, coalesce(sum(g / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM got GROUP BY ALL),
    ideal AS (SELECT query_id, sum(g / log2(p + 1)) AS idcg FROM (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS p FROM rel) WHERE p <= 10 GROUP BY query_id),
    m AS (SELECT query_id, label, r3, r10, mrr, dcg / idcg AS ndcg, label % 2 = 0 AS even, query_id % 3 AS kind FROM per JOIN ideal USING (query_id))"""


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, must, ok = F.col("ranked"), F.col("must"), F.col("acceptable")
    return _lists(spark, sf_dir).select(
        "query_id", "label", M.recall(r, must, 3).alias("r3"), M.recall(r, must, 10).alias("r10"), M.reciprocal_rank(r, must).alias("mrr"), M.ndcg(r, must, ok).alias("ndcg"), M.diversity(r).cast("long").alias("diversity"),
        (F.col("label") % 2 == 0).alias("even"), (F.col("query_id") % 3).alias("kind"),
    )


@query("ranking_metrics", f"WITH {_LISTS} SELECT query_id, round(r3, 6) AS recall_at_3, round(r10, 6) AS recall_at_10, round(mrr, 6) AS mrr_at_10, round(ndcg, 6) AS ndcg_at_10, (SELECT count(*) FROM top t WHERE t.query_id = m.query_id AND rank <= 10) AS diversity FROM m")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _measured(spark, sf_dir)
    return m.select("query_id", F.round("r3", 6).alias("recall_at_3"), F.round("r10", 6).alias("recall_at_10"), F.round("mrr", 6).alias("mrr_at_10"), F.round("ndcg", 6).alias("ndcg_at_10"), "diversity")


@query("metric_rollups", f"""WITH {_LISTS} SELECT kind, even, count(*) AS questions, round(avg(r3), 6) AS recall_at_3, round(avg(mrr), 6) AS mrr_at_10, round(avg(ndcg), 6) AS ndcg_at_10, round(avg(r10) FILTER (kind = 2) - avg(r10) FILTER (kind = 0), 6) AS cross_delta
    FROM m GROUP BY GROUPING SETS ((), (kind), (even))""")  # fmt: skip
def metric_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same averages overall, by type and by language: one pass with grouping sets."""
    m = _measured(spark, sf_dir).withColumn("k", F.col("kind"))
    delta = F.avg(F.when(F.col("k") == 2, F.col("r10"))) - F.avg(F.when(F.col("k") == 0, F.col("r10")))
    grouped = m.groupingSets([[], ["kind"], ["even"]], "kind", "even")
    return grouped.agg(F.count("*").alias("questions"), F.round(F.avg("r3"), 6).alias("recall_at_3"), F.round(F.avg("mrr"), 6).alias("mrr_at_10"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_10"), F.round(delta, 6).alias("cross_delta"))


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_LEAK = f"""
    pr AS (SELECT item_id AS id, b.text AS question, d.text AS answer FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    qt AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest({_TERMS.replace('text', 'question')}) AS term FROM pr) GROUP BY ALL),
    an AS (SELECT DISTINCT id, unnest({_TERMS.replace('text', 'answer')}) AS term FROM pr),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TERMS})) AS term FROM documents) GROUP BY term), nn AS (SELECT count(*) AS n FROM documents),
    x AS (SELECT id, times, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf, an.term IS NOT NULL AS shared, n FROM qt LEFT JOIN df USING (term) LEFT JOIN an USING (id, term), nn),
    lk AS (SELECT id, sum(CASE WHEN shared THEN idf * times ELSE 0 END) / nullif(sum(idf * times), 0) AS share, coalesce(max(idf) FILTER (shared), 0) / ln(max(n) + 1) AS peak, count(*) FILTER (shared) AS leaked FROM x GROUP BY id)"""


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    pairs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")).join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("answer")), "id")
    return M.leakage(pairs, docs)


@query("leakage", f"WITH {_LEAK} SELECT id, round(share, 6) AS share, round(peak, 6) AS peak, leaked FROM lk")
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("id", F.round("share", 6).alias("share"), F.round("peak", 6).alias("peak"), "leaked")


@query("leakage_bands", f"""WITH {_LEAK} SELECT peak >= 0.2 AS high, count(*) AS questions, round(avg(share), 6) AS mean_share, round(avg(peak), 6) AS mean_peak, count(*) FILTER (peak >= 0.5) AS over_gate FROM lk WHERE peak IS NOT NULL GROUP BY 1""")
def leakage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _leaks(spark, sf_dir).where("peak IS NOT NULL").withColumn("high", F.col("peak") >= 0.2)
    return rows.groupBy("high").agg(
        F.count("*").alias("questions"), F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.avg("peak"), 6).alias("mean_peak"), F.count_if(F.col("peak") >= M.LEAK_GATE).alias("over_gate"),
    )


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rerank outcomes: ranks from their keys, null where the answer was outside the pool."""
    o = read(spark, sf_dir, "orders")
    base = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 60 + 1)
    after = F.when(F.col("o_custkey") % 13 != 0, F.when(base <= 40, (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 40 + 1).otherwise(base))
    return o.select(F.col("o_orderpriority").alias("corpus"), base.alias("base_rank"), after.alias("reranked_rank"), (F.col("o_custkey") % 100 + 60).alias("pool_documents"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 50 + 40).alias("reranked_pool_documents"), F.lit(40).alias("rerank_depth"))


_OUT = """o AS (SELECT o_orderpriority AS corpus, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 60 + 1 END AS base, o_custkey AS c, o_orderkey AS k FROM orders),
    oc AS (SELECT *, CASE WHEN c % 13 <> 0 THEN CASE WHEN base <= 40 THEN (k * 7 + c) % 40 + 1 ELSE base END END AS aft, c % 100 + 60 AS pool, CASE WHEN c % 5 <> 0 THEN c % 50 + 40 END AS rpool FROM o)"""


@query("ablation_buckets", f"""WITH {_OUT}, s AS (SELECT *, CASE WHEN base > 40 THEN base ELSE 20.5 END AS ex, CASE WHEN base = 1 THEN '1' WHEN base <= 3 THEN '2-3' WHEN base <= 10 THEN '4-10' WHEN base <= 40 THEN '11-40' ELSE '41+' END AS bucket FROM oc WHERE base IS NOT NULL AND aft IS NOT NULL)
    SELECT corpus, bucket, count(*) AS n, count(*) FILTER (base > aft) AS helped, count(*) FILTER (base < aft) AS hurt, count(*) FILTER (base = aft) AS unchanged, round(avg(aft), 6) AS mean_reranked, round(avg(ex) - avg(aft), 6) AS beats_null,
           round(avg((base <= 3)::INT), 6) AS recall_before, round(avg((aft <= 3)::INT), 6) AS recall_after FROM s GROUP BY ALL""")  # fmt: skip
def ablation_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return M.bucket_summary(_outcomes(spark, sf_dir), ("corpus",)).select("corpus", "bucket", "n", "helped", "hurt", "unchanged", r("mean_reranked"), r("beats_null"), r("recall_before"), r("recall_after"))


@query("ablation_summary", f"""WITH {_OUT} SELECT corpus, count(*) AS questions, count(*) FILTER (base IS NULL OR aft IS NULL) AS outside_pool, count(*) FILTER (base IS NOT NULL AND aft IS NULL) AS evicted, count(*) FILTER (base IS NULL AND aft IS NOT NULL) AS rescued,
           round(avg(pool), 6) AS mean_pool, round(avg(rpool), 6) AS mean_reranked_pool, round(avg(coalesce(base <= 3, false)::INT), 6) AS recall_before, round(avg(coalesce(aft <= 3, false)::INT), 6) AS recall_after FROM oc GROUP BY ROLLUP (corpus)""")  # fmt: skip
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return M.ablation_summary(_outcomes(spark, sf_dir)).select("corpus", "questions", "outside_pool", "evicted", "rescued", r("mean_pool"), r("mean_reranked_pool"), r("recall_before"), r("recall_after"))


@query("reach", f"""WITH {_OUT}, t AS (SELECT corpus, count(*) AS questions, count(*) FILTER (base IS NULL) AS never_ranked FROM oc GROUP BY corpus),
    md AS (SELECT corpus, base AS median_rank FROM (SELECT corpus, base, row_number() OVER (PARTITION BY corpus ORDER BY base) - 1 AS i, count(*) OVER (PARTITION BY corpus) AS m FROM oc WHERE base IS NOT NULL) WHERE i = m // 2)
    SELECT corpus, c.ceiling::INT AS ceiling, count(*) FILTER (base <= c.ceiling) AS within, any_value(questions) AS questions, any_value(never_ranked) AS never_ranked, any_value(median_rank) AS median_rank, round(count(*) FILTER (base <= c.ceiling) / any_value(questions), 6) AS share
    FROM oc JOIN t USING (corpus) JOIN md USING (corpus), (SELECT unnest([3, 10, 40]) AS ceiling) c GROUP BY ALL""")  # fmt: skip
def reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.reach(_outcomes(spark, sf_dir).select("corpus", F.col("base_rank").alias("rank")), (3, 10, 40), "corpus")
    return out.select("corpus", "ceiling", "within", "questions", "never_ranked", "median_rank", F.round("share", 6).alias("share"))


@query("score_separation", f"""WITH {COSINE_SQL}, md AS (SELECT query_id, count(*) AS n, max(score) AS best, median(score) FILTER (rank > 1) AS mid FROM vec GROUP BY query_id),
    sp AS (SELECT query_id, median(abs(score - mid)) AS mad FROM vec JOIN md USING (query_id) WHERE rank > 1 GROUP BY query_id)
    SELECT query_id, n, round(CASE WHEN n >= 8 AND mad <> 0 THEN (best - mid) / (1.4826 * mad) END, 6) AS separation FROM md JOIN sp USING (query_id)""")  # fmt: skip
def score_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No score is shuffled: medians are found by counting."""
    rows, queries = compared(spark, sf_dir)
    return spread.middles(rows, queries).select("query_id", "n", F.round(M.separated(), 6).alias("separation"))


_PAIRS = "h AS (SELECT l_suppkey % 7 AS origin, l_returnflag = 'R' AS positive, round(l_extendedprice, -3)::DOUBLE AS score FROM lineitem)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("origin"), (F.col("l_returnflag") == "R").alias("positive"), F.round("l_extendedprice", -3).alias("score"))


@query("auc", f"""WITH {_PAIRS}, c AS (SELECT origin, score, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS q FROM h GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY origin ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT origin, round(sum(p * (below + q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM b GROUP BY origin""")  # fmt: skip
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.auc(_scored(spark, sf_dir), "origin").select("origin", F.round("auc", 6).alias("auc"))


@query("abstention_separation", f"""WITH {_PAIRS}, s AS (SELECT origin, count(*) FILTER (positive) AS positives, count(*) FILTER (NOT positive) AS abstentions, median(score) FILTER (NOT positive) AS a, median(score) FILTER (positive) AS p, quantile_cont(score, 0.25) FILTER (positive) AS p25 FROM h GROUP BY origin)
    SELECT origin, any_value(positives) AS positives, any_value(abstentions) AS abstentions, round(any_value(a), 6) AS abstention_median, round(any_value(p), 6) AS positive_median, round(any_value(p25), 6) AS positive_p25, round(count(*) FILTER (NOT positive AND score < p25) / any_value(abstentions), 6) AS below_p25 FROM h JOIN s USING (origin) GROUP BY origin""")  # fmt: skip
def abstention_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return M.abstention(_scored(spark, sf_dir), "origin").select("origin", "positives", "abstentions", r("abstention_median"), r("positive_median"), r("positive_p25"), r("below_p25"))


@query("home_foreign_pairs", """
    WITH m AS (SELECT l_suppkey AS origin, l_partkey AS id, CASE WHEN l_linestatus = 'F' THEN 'home' ELSE 'foreign' END AS label, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
         p AS (SELECT origin, id, max(score) FILTER (label = 'home') AS home, max(score) FILTER (label = 'foreign') AS other FROM m GROUP BY ALL)
    SELECT origin, count(*) AS pairs, count(*) FILTER (home > other) AS wins, count(*) FILTER (home < other) AS losses FROM p WHERE home IS NOT NULL AND other IS NOT NULL GROUP BY origin""")  # fmt: skip
def home_foreign_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete pairs of an id's scores at home and abroad, and who wins: the input of a sign test."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("origin"), F.col("l_partkey").alias("id"), F.when(F.col("l_linestatus") == "F", "home").otherwise("foreign").alias("label"), F.col("l_quantity").alias("score"))
    pairs = rows.groupBy("origin", "id").pivot("label", ["home", "foreign"]).agg(F.max("score")).dropna(subset=["home", "foreign"])
    return pairs.groupBy("origin").agg(F.count("*").alias("pairs"), F.count_if(F.col("home") > F.col("foreign")).alias("wins"), F.count_if(F.col("home") < F.col("foreign")).alias("losses"))
