"""Evaluates lexical retrieval over a corpus with a set of questions, and reports by question and in sum.

Documents (doc_id, text) and questions (item_id, text) are Parquet. What a question should find is every document that holds its text verbatim; what is
acceptable, every document in which its rarest term occurs at least twice. A run writes, under a label of its own (a date, a release),

    <output>/questions/run=<label>/language=…   JSON lines: truth, hits, recall, reciprocal rank, nDCG, diversity and what was ranked, by question
    <output>/summary/run=<label>/by=…           JSON lines: means over all questions, by language, and by whether a question has an answer at all

and overwrites what an earlier run of that label has left, so it may be run again at any time with the same result; other labels stay.

All questions are one batch: the stored index of the documents is built once for a state of their files, rankings are pruned top-k, and no step pairs every
question with every document. Defined cases: null texts are empty and find nothing; a question without an answer has null recall, which means leave out;
empty tables give empty reports; further columns are left out.

    spark-submit --py-files … jobs/retrieval_report.py --config jobs/retrieval_report.json --documents <path> --questions <path> --output <folder> --run <label>
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.functions import text as T
from attestor.operators import lexical as L, metrics as M

log = logging.getLogger("jobs.retrieval_report")

DEFAULTS = {"documents": None, "questions": None, "output": None, "run": None, "depth": 10}
QUESTION = "item_id long, must long, acceptable long, found long, first_rank int, recall_at_3 double, recall_at_k double, mrr double, ndcg double, diversity long, ranked array<long>, language string"
SUMMARY = "value string, questions long, answered long, recall_at_3 double, recall_at_k double, mrr double, ndcg double, by string"
NONE = "none"


def relevance(docs: DataFrame, questions: DataFrame, index: L.Index) -> DataFrame:
    """(query_id, ref, gain): 2 for what must be found, 1 for what is acceptable."""
    twice = L.held(index, L.rarest(index, questions)).where("tf >= 2").select("query_id", "ref", F.lit(1).alias("gain"))
    return L.holding(index, docs, questions).withColumn("gain", F.lit(2)).unionByName(twice)


def measured(docs: DataFrame, questions: DataFrame, index: L.Index, depth: int) -> DataFrame:
    """A row per question: the columns of QUESTION."""
    ranking = scratch.cut(L.top(index, questions, depth).select("query_id", "ref", "rank"), "report-ranking")
    order = ranking.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref"))).alias("r"))  # ``depth`` at most
    told = M.judge(questions, ranking, relevance(docs, questions, index), depth)
    rows = questions.select("query_id", F.coalesce(T.language(F.col("text")), F.lit(NONE)).alias("language")).join(told, "query_id").join(order, "query_id", "left")
    exact = lambda c: F.round(c, 6).alias(c)
    return rows.select(
        F.col("query_id").alias("item_id"), "must", "acceptable", "found", "first_rank", *map(exact, ("recall_at_3", "recall_at_k", "mrr", "ndcg")), "diversity",
        F.coalesce(F.col("r.ref"), F.array().cast("array<long>")).alias("ranked"), "language",
    )


def summed(rows: DataFrame) -> DataFrame:
    """Means of all questions, by language and by whether there is an answer: one pass over the questions."""
    rows = rows.withColumn("answer", F.when(F.col("must") > 0, "answered").otherwise("unanswered"))
    grouped = rows.groupingSets([[], ["language"], ["answer"]], "language", "answer")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    out = grouped.agg(F.grouping_id().alias("g"), F.count("*").alias("questions"), F.count_if(F.col("must") > 0).alias("answered"), *map(mean, ("recall_at_3", "recall_at_k", "mrr", "ndcg")))
    by = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "language").otherwise("answer")
    return out.where("questions > 0").select(F.coalesce("language", "answer", F.lit("all")).alias("value"), "questions", "answered", "recall_at_3", "recall_at_k", "mrr", "ndcg", by.alias("by"))


def run(spark: SparkSession, documents: str, questions: str, output: str, run: str, depth: int = 10) -> dict[str, Any]:
    """Evaluates and writes the report of label ``run``; the number of documents and questions read and of rows written."""
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long").alias("ref"), "text")
    asked = spark.read.parquet(questions).select(F.col("item_id").cast("long").alias("query_id"), "text")
    index = L.opened(spark, documents, "doc_id", "text")
    done = {"documents": index.n, "questions": asked.count()}
    log.info("%d documents read from %s, %d questions from %s", done["documents"], documents, done["questions"], questions)
    rows = scratch.cut(measured(docs, asked, index, depth), "retrieval-report")
    for name, made, by in (("questions", rows, "language"), ("summary", summed(rows), "by")):
        path = f"{output}/{name}/run={run}"
        made.write.mode("overwrite").partitionBy(by).json(path)
        done[f"{name}_written"] = spark.read.schema(QUESTION if name == "questions" else SUMMARY).json(path).count()
        log.info("%d rows of %s written to %s", done[f"{name}_written"], name, path)
    scratch.drop(rows)
    return done


def report(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """The questions and sums of all labels."""
    return spark.read.schema(f"{QUESTION}, run string").json(f"{output}/questions"), spark.read.schema(f"{SUMMARY}, run string").json(f"{output}/summary")


if __name__ == "__main__":
    from jobs.command import main

    main(run, DEFAULTS, "retrieval report")
