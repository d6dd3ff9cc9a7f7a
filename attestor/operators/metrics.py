"""Retrieval evaluation as set-oriented aggregates: undefined is null and stays out of averages, a miss is zero."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.functions import text as T

# Fixed values of the statistics.
LEAST_SCORES = 8
MAD_TO_SIGMA = 1.4826
BUCKETS = (("1", 1, 1), ("2-3", 2, 3), ("4-10", 4, 10), ("11-40", 11, 40), ("41+", 41, None))
LEAK_GATE = 0.5


def recall(ranked: Column, must: Column, k: int) -> Column:
    """Share of ``must`` in the first k; names that ``must`` repeats count each time; null without truth."""
    top = F.slice(ranked, 1, k)
    return F.when(F.size(must) > 0, F.size(F.filter(must, lambda m: F.array_contains(top, m))) / F.size(must))


def reciprocal_rank(ranked: Column, must: Column, k: int = 10) -> Column:
    hits = F.filter(F.transform(F.slice(ranked, 1, k), lambda x, i: F.when(F.array_contains(must, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(must) > 0, F.coalesce(F.lit(1.0) / F.array_min(hits), F.lit(0.0)))


def _discounted(gains: Column) -> Column:
    return F.aggregate(F.transform(gains, lambda g, i: g / F.log2(i.cast("double") + 2)), F.lit(0.0), lambda s, x: s + x)


def ndcg(ranked: Column, must: Column, acceptable: Column, k: int = 10) -> Column:
    """Linear gains 2 and 1; the ideal holds every relevant name, k at most; what is in ``must`` isn't merely acceptable."""
    only = F.filter(acceptable, lambda a: ~F.array_contains(must, a))
    gain = F.transform(F.slice(ranked, 1, k), lambda x: F.when(F.array_contains(must, x), 2.0).when(F.array_contains(only, x), 1.0).otherwise(0.0))
    ideal = F.slice(F.concat(F.transform(must, lambda _: F.lit(2.0)), F.transform(only, lambda _: F.lit(1.0))), 1, k)
    return F.when(F.size(must) + F.size(only) > 0, _discounted(gain) / _discounted(ideal))


def diversity(ranked: Column, k: int = 10) -> Column:
    return F.size(F.array_distinct(F.slice(ranked, 1, k)))


def judge(queries: DataFrame, ranking: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """The measures above per query from rows instead of arrays, for truths of any size: no query's truth is gathered.

    ``queries``: query_id; ``ranking``: query_id, ref, rank; ``relevance``: query_id, ref, gain (2 what must be found, 1 what is acceptable; the greater one counts). Gives must,
    acceptable, found, first_rank, recall_at_3, recall_at_k, mrr, ndcg, diversity; what is undefined without truth is null.
    """
    relevance = relevance.groupBy("query_id", "ref").agg(F.max("gain").alias("gain"))
    top, must = ranking.where(F.col("rank") <= k), F.col("gain") == 2
    hits = top.join(relevance, ["query_id", "ref"], "left").groupBy("query_id").agg(
        F.count_if(must).alias("found"), F.count_if(must & (F.col("rank") <= 3)).alias("early"), F.min(F.when(must, F.col("rank"))).alias("first_rank"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.count_distinct("ref").alias("diversity"),
    )
    truth = relevance.groupBy("query_id").agg(F.count_if(must).alias("must"), F.count_if(~must).alias("acceptable"))
    rows = queries.select("query_id").join(truth, "query_id", "left").join(hits, "query_id", "left").na.fill(0, ["must", "acceptable", "found", "early", "diversity"])
    gain = lambda p: F.when(p <= F.col("must"), 2.0).when(p <= F.col("must") + F.col("acceptable"), 1.0).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, p: s + gain(p) / F.log2(p + 1.0))
    of = lambda condition, value: F.when(condition, value)
    answered = F.col("must") > 0
    return rows.select(
        "query_id", "must", "acceptable", "found", F.col("first_rank").cast("int").alias("first_rank"), of(answered, F.col("early") / F.col("must")).alias("recall_at_3"), of(answered, F.col("found") / F.col("must")).alias("recall_at_k"),
        of(answered, F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))).alias("mrr"), of(F.col("must") + F.col("acceptable") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), "diversity",
    )


def term_statistics(corpus: DataFrame, vocabulary: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Document frequency of the terms of ``vocabulary`` (term), zeros too, and the one-row number of documents."""
    held = corpus.select(F.explode(F.array_distinct(T.terms(F.col(text)))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return vocabulary.join(held, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), corpus.agg(F.count("*").alias("documents"))


def leakage(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """Of (id, question, answer) the share and peak of what a question gives away, and the number of terms it shares."""
    asked = pairs.select("id", F.explode(T.terms(F.col("question"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("times"))
    own = pairs.select("id", F.explode(F.array_distinct(T.terms(F.col("answer")))).alias("term")).withColumn("shared", F.lit(True))
    frequency, n = term_statistics(corpus, asked.select("term").distinct())
    rows = asked.join(frequency, "term").crossJoin(F.broadcast(n)).join(own, ["id", "term"], "left")
    rows = rows.withColumn("idf", F.log((F.col("documents") + 1) / (F.col("df") + 1)))
    shared = F.col("shared").isNotNull()
    out = rows.groupBy("id").agg(
        F.sum(F.col("idf") * F.col("times")).alias("weight"), F.sum(F.when(shared, F.col("idf") * F.col("times")).otherwise(0.0)).alias("given"),
        F.max(F.when(shared, F.col("idf"))).alias("top"), F.count(F.when(shared, 1)).alias("leaked"), F.log(F.max("documents") + 1).alias("ceiling"),
    )
    share = F.when(F.col("weight") != 0, F.col("given") / F.col("weight")).otherwise(0.0)
    peak = F.when(F.col("ceiling") != 0, F.coalesce("top", F.lit(0.0)) / F.col("ceiling")).otherwise(0.0)
    return pairs.select("id").join(out.select("id", share.alias("share"), peak.alias("peak"), "leaked"), "id", "left")


def bucket(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, low, high in reversed(BUCKETS):
        out = F.when((rank >= low) & (F.lit(True) if high is None else rank <= high), label).otherwise(out)
    return out


def expected_rank(base: Column, depth: Column) -> Column:
    """Where a uniform shuffle of the first ``depth`` would put a document on average."""
    return F.when(base > depth, base.cast("double")).otherwise((depth + 1) / 2)


def _share(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def bucket_summary(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per bucket of the base rank: what a rerank did, against a shuffle. Outcomes without both ranks aren't scored."""
    rows = outcomes.where("base_rank IS NOT NULL AND reranked_rank IS NOT NULL").withColumn("bucket", bucket(F.col("base_rank"))).withColumn("moved", F.col("base_rank") - F.col("reranked_rank"))
    rows = rows.withColumn("expected", expected_rank(F.col("base_rank"), F.col("rerank_depth")))
    return rows.groupBy(*by, "bucket").agg(
        F.count("*").alias("n"), F.count_if(F.col("moved") > 0).alias("helped"), F.count_if(F.col("moved") < 0).alias("hurt"), F.count_if(F.col("moved") == 0).alias("unchanged"),
        F.avg("base_rank").alias("mean_base"), F.avg("reranked_rank").alias("mean_reranked"), F.avg("expected").alias("mean_expected"), (F.avg("expected") - F.avg("reranked_rank")).alias("beats_null"),
        _share(F.col("base_rank") <= 3).alias("recall_before"), _share(F.col("reranked_rank") <= 3).alias("recall_after"),
    )


def ablation_summary(outcomes: DataFrame) -> DataFrame:
    """Per corpus and pooled (corpus null): pools, evictions, and recall in which a document outside the pool is a miss."""
    base, after = F.col("base_rank"), F.col("reranked_rank")
    return outcomes.rollup("corpus").agg(
        F.count("*").alias("questions"), F.count_if(base.isNull() | after.isNull()).alias("outside_pool"), F.count_if(base.isNotNull() & after.isNull()).alias("evicted"),
        F.count_if(base.isNull() & after.isNotNull()).alias("rescued"), F.avg("pool_documents").alias("mean_pool"), F.avg("reranked_pool_documents").alias("mean_reranked_pool"),
        _share(F.coalesce(base <= 3, F.lit(False))).alias("recall_before"), _share(F.coalesce(after <= 3, F.lit(False))).alias("recall_after"),
    )


def reach(ranks: DataFrame, ceilings: tuple[int, ...], by: str) -> DataFrame:
    """Share of questions whose answer lies within each ceiling; never ranked counts against all. The median is the upper one."""
    least = F.explode(F.array(*map(F.lit, ceilings))).alias("ceiling")
    totals = ranks.groupBy(by).agg(F.count("*").alias("questions"), F.count_if(F.col("rank").isNull()).alias("never_ranked"))
    place = Window.partitionBy(by).orderBy("rank")
    known = ranks.where("rank IS NOT NULL").withColumn("i", F.row_number().over(place) - 1).withColumn("m", F.count("*").over(Window.partitionBy(by)))
    median = known.where(F.col("i") == F.floor(F.col("m") / 2)).select(by, F.col("rank").alias("median_rank"))
    within = ranks.select(by, "rank", least).groupBy(by, "ceiling").agg(F.count_if(F.col("rank") <= F.col("ceiling")).alias("within"))
    return within.join(totals, by).join(median, by, "left").withColumn("share", F.col("within") / F.col("questions"))


def separation(scores: DataFrame, by: str, score: str = "score", tie: str = "ref") -> DataFrame:
    """Robust deviations between a query's best score and the median of the rest; null below eight scores or without spread."""
    rows = scores.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie)))
    middle = rows.groupBy(by).agg(F.count("*").alias("n"), F.max(score).alias("best"), F.median(F.when(F.col("r") > 1, F.col(score))).alias("mid"))
    spread = rows.where("r > 1").join(middle.select(by, "mid"), by).groupBy(by).agg(F.median(F.abs(F.col(score) - F.col("mid"))).alias("mad"))
    return middle.join(spread, by, "left").select(by, "n", separated().alias("separation"))


def separated() -> Column:
    """``separation`` from what is known of a query's scores: n, best, mid and mad."""
    return F.when((F.col("n") >= LEAST_SCORES) & (F.col("mad") != 0), (F.col("best") - F.col("mid")) / (MAD_TO_SIGMA * F.col("mad")))


def auc(scores: DataFrame, by: str, positive: str = "positive", score: str = "score") -> DataFrame:
    """Probability that a positive outscores a negative, ties half: rank sums with mean ranks, counted per distinct score."""
    per = scores.groupBy(by, score).agg(F.count_if(F.col(positive)).alias("__yes"), F.count_if(~F.col(positive)).alias("__no"))
    below = F.coalesce(F.sum("__no").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = per.withColumn("__wins", F.col("__yes") * (below + F.col("__no") / 2)).groupBy(by).agg(F.sum("__wins").alias("__wins"), F.sum("__yes").alias("__yes"), F.sum("__no").alias("__no"))
    pairs = F.col("__yes") * F.col("__no")
    return wins.select(by, F.when(pairs > 0, F.col("__wins") / pairs).alias("auc"))


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial tail at one half; ties are left out beforehand."""
    n = wins + losses
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(wins, losses) + 1))
    return min(1.0, 2 * tail / 2**n)


def abstention(scores: DataFrame, by: str) -> DataFrame:
    """Medians of both sides' best scores, the positives' 25th percentile, and the share of abstentions below it; null if a side is empty."""
    yes, no = F.when(F.col("positive"), F.col("score")), F.when(~F.col("positive"), F.col("score"))
    sides = scores.groupBy(by).agg(F.count(yes).alias("positives"), F.count(no).alias("abstentions"), F.median(yes).alias("p"), F.median(no).alias("a"), F.percentile(yes, 0.25).alias("p25"))
    below = scores.join(sides, by).groupBy(by).agg(F.count_if(~F.col("positive") & (F.col("score") < F.col("p25"))).alias("below"))
    both = (F.col("positives") > 0) & (F.col("abstentions") > 0)
    kept = lambda c, name: F.when(both, F.col(c)).alias(name)
    return sides.join(below, by).select(by, "positives", "abstentions", kept("a", "abstention_median"), kept("p", "positive_median"), kept("p25", "positive_p25"), F.when(both, F.col("below") / F.col("abstentions")).alias("below_p25"))
