"""The jobs as queries: each runs its function twice into one new folder of the shared one, and returns what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.functions import text as T
from attestor.plans import catalog  # noqa: F401  first: it loads the others in order
from attestor.plans import retrieval as plans, text as texts
from jobs import passage_store, retrieval_report

WINDOW, DEPTH = 2000, 10
BM25_SQL, COUNTS_SQL, LANGUAGE_SQL = plans.BM25_SQL, texts.COUNTS_SQL, texts.LANGUAGE_SQL
_TOKENS = "regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}_]+')"
_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{c}' END" for c, p in T.ADVISORIES)

ORACLES = {
    "job1_passages": f"""
        WITH v AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') AS source FROM documents),
             d AS (SELECT *, sha256(text) AS h, 'doc:v1:' || sha256(source || '/' || coalesce(doc_id::VARCHAR, sha256(text)) || '.md') AS document_ref FROM v),
             t AS (SELECT doc_id, document_ref, array_to_string(list_filter([{_HITS}], lambda c: c IS NOT NULL), ',') AS advisories, {LANGUAGE_SQL} AS document_language FROM (SELECT *, {COUNTS_SQL} FROM d)),
             p AS (SELECT doc_id, document_ref, source, h, i AS ordinal, 1 + i * {WINDOW} AS start, substr(text, 1 + i * {WINDOW}, {WINDOW}) AS text FROM (SELECT *, unnest(range((length(text) + {WINDOW} - 1) // {WINDOW})) AS i FROM d)),
             q AS (SELECT *, {LANGUAGE_SQL} AS language FROM (SELECT *, {COUNTS_SQL} FROM p))
        SELECT doc_id, document_ref, source, 'chunk:v1:' || sha256(document_ref || chr(0) || h || chr(0) || ordinal) AS ref, ordinal, start, start + length(text) - 1 AS stop, language, len({_TOKENS}) AS n_tokens, sha256(text) AS text_sha256,
               advisories, document_language FROM q JOIN t USING (doc_id, document_ref)""",
    "job2_report": f"""
        WITH {BM25_SQL},
             top AS (SELECT query_id, ref, rank FROM lex WHERE rank <= {DEPTH}),
             ra AS (SELECT query_id, arg_min(term, {{'df': df, 'term': term}}) AS term FROM q JOIN df USING (term) GROUP BY query_id),
             re AS (SELECT query_id, ref, max(gain) AS gain FROM (SELECT item_id AS query_id, doc_id AS ref, 2 AS gain FROM benchmark b JOIN documents d ON contains(d.text, b.text)
                    UNION ALL SELECT query_id, ref, 1 FROM ra JOIN tf USING (term) WHERE tf >= 2) GROUP BY ALL),
             tr AS (SELECT query_id, count(*) FILTER (gain = 2) AS must, count(*) FILTER (gain = 1) AS acceptable FROM re GROUP BY 1),
             hi AS (SELECT query_id, count(*) FILTER (gain = 2) AS found, count(*) FILTER (gain = 2 AND rank <= 3) AS early, min(rank) FILTER (gain = 2) AS first_rank, sum(gain / log2(rank + 1)) AS dcg, count(DISTINCT ref) AS diversity,
                           array_to_string(list(ref ORDER BY rank), ',') AS ranked FROM top LEFT JOIN re USING (query_id, ref) GROUP BY 1),
             la AS (SELECT item_id, {LANGUAGE_SQL} AS language FROM (SELECT item_id, {COUNTS_SQL} FROM benchmark)),
             al AS (SELECT item_id, coalesce(must, 0) AS must, coalesce(acceptable, 0) AS acceptable, coalesce(found, 0) AS found, coalesce(early, 0) AS early, first_rank, coalesce(dcg, 0) AS dcg, coalesce(diversity, 0) AS diversity, coalesce(ranked, '') AS ranked,
                           coalesce(language, 'none') AS language FROM la LEFT JOIN tr ON tr.query_id = item_id LEFT JOIN hi ON hi.query_id = item_id),
             m AS (SELECT *, list_sum(list_transform(range(1, {DEPTH} + 1), lambda p: CASE WHEN p <= must THEN 2.0 WHEN p <= must + acceptable THEN 1.0 ELSE 0.0 END / log2(p + 1))) AS ideal FROM al),
             r AS (SELECT item_id, must, acceptable, found, first_rank, CASE WHEN must > 0 THEN round(early / must, 6) END AS recall_at_3, CASE WHEN must > 0 THEN round(found / must, 6) END AS recall_at_k,
                          CASE WHEN must > 0 THEN round(coalesce(1.0 / first_rank, 0), 6) END AS mrr, CASE WHEN must + acceptable > 0 THEN round(dcg / ideal, 6) END AS ndcg, diversity, ranked, language FROM m),
             s AS (SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(must > 0) = 0 THEN 'answer' ELSE 'all' END AS kind, coalesce(language, CASE must > 0 WHEN true THEN 'answered' WHEN false THEN 'unanswered' END, 'all') AS name,
                          count(*) AS questions, count(*) FILTER (must > 0) AS answered, round(avg(recall_at_3), 6) AS recall_at_3, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg
                   FROM r GROUP BY GROUPING SETS ((), (language), (must > 0)))
        SELECT 'question' AS kind, item_id::VARCHAR AS name, language, must, acceptable, found, first_rank, diversity, ranked, recall_at_3, recall_at_k, mrr, ndcg FROM r
        UNION ALL SELECT kind, name, NULL, questions, NULL, answered, NULL, NULL, NULL, recall_at_3, recall_at_k, mrr, ndcg FROM s WHERE questions > 0""",
}


def job1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of all documents with what the store tells of theirs."""
    output = scratch.new_path(spark, "job1")
    for _ in range(2):
        passage_store.run(spark, f"{sf_dir}/documents.parquet*", output, passage_characters=WINDOW)  # a file or a folder of files
    told, parts = passage_store.current(spark, output)
    told = told.select("document_ref", F.array_join("advisories", ",").alias("advisories"), F.col("language").alias("document_language"))
    rows = parts.join(told, "document_ref")
    return rows.select("doc_id", "document_ref", "source", "ref", F.col("ordinal").cast("long").alias("ordinal"), "start", "stop", "language", "n_tokens", F.sha2("text", 256).alias("text_sha256"), "advisories", "document_language")


def job2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, questions and sums."""
    output = scratch.new_path(spark, "job2")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", output, "whole", DEPTH)
    questions, sums = retrieval_report.report(spark, output)
    means = ("recall_at_3", "recall_at_k", "mrr", "ndcg")
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    each = questions.select(F.lit("question").alias("kind"), F.col("item_id").cast("string").alias("name"), "language", "must", "acceptable", "found", F.col("first_rank").cast("long").alias("first_rank"), "diversity", F.array_join("ranked", ",").alias("ranked"), *means)
    return each.unionByName(sums.select(
        F.col("by").alias("kind"), F.col("value").alias("name"), no("string", "language"), F.col("questions").alias("must"), no("long", "acceptable"), F.col("answered").alias("found"), no("long", "first_rank"), no("long", "diversity"), no("string", "ranked"), *means,
    ))


QUERIES = {"job1_passages": job1_passages, "job2_report": job2_report}
