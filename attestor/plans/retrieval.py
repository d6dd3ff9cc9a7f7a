"""Retrieval over the driver's tables: benchmark items are queries, documents passages, embeddings the vector leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.functions import text as T
from attestor.operators import fusion, lexical as L, retrieval as R
from attestor.plans.catalog import query, read
from attestor.plans.text import COUNTS_SQL, LANGUAGE_SQL

_TOKENS = "regexp_extract_all(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}_]+')"
BM25_SQL = f"""
    q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
    d AS (SELECT doc_id AS ref, {_TOKENS} AS t FROM documents),
    st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
    tf AS (SELECT ref, dl, term, count(*) AS tf FROM (SELECT ref, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    bm AS (SELECT query_id, ref, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
           FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM bm)"""
COSINE_SQL = """
    e AS (SELECT vec_id AS ref, embedding::DOUBLE[] AS v, label, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS nv FROM embeddings),
    cs AS (SELECT b.ref AS query_id, a.ref, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 9) AS score FROM e a, e b WHERE b.ref % 50 = 0 AND a.nv > 0 AND b.nv > 0),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM cs)"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "text")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark: SparkSession, sf_dir: str) -> L.Index:
    """The stored postings of the documents: built by the first query that needs them."""
    return L.opened(spark, f"{sf_dir}/documents.parquet", "doc_id", "text")


def lexical(spark: SparkSession, sf_dir: str, k: int | None = None) -> DataFrame:
    found, questions = index(spark, sf_dir), _questions(spark, sf_dir)
    return L.top(found, questions, k) if k else R.ranked(L.scores(found, questions))


def compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors (ref, vector), and as queries (query_id, vector) those whose id is divisible by 50."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vector"))
    return rows, rows.where("ref % 50 = 0").select(F.col("ref").alias("query_id"), "vector")


def vectors(spark: SparkSession, sf_dir: str, asked: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """Cosine of every vector with those whose id is divisible by 50, or those of them that are asked for (query_id)."""
    rows, queries = compared(spark, sf_dir)
    return R.cosine(rows, queries if asked is None else queries.join(asked, "query_id", "left_semi"), k)


@query("lexical_index", f"WITH {BM25_SQL.replace('WHERE term IN (SELECT term FROM q) ', '')} SELECT term, df FROM df")
def lexical_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the stored index with their document frequencies."""
    return index(spark, sf_dir).terms.select("term", "df")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, rank, ref, round(score, 6) AS score FROM lex WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, 10).select("query_id", F.col("rank").cast("long").alias("rank"), "ref", F.round("score", 6).alias("score"))


def held_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, ref) of the documents that hold an item's text."""
    return L.holding(index(spark, sf_dir), _passages(spark, sf_dir), _questions(spark, sf_dir))


@query("bm25_recall", f"""WITH {BM25_SQL},
    truth AS (SELECT item_id AS query_id, doc_id AS ref FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    hit AS (SELECT query_id, count(*) AS must, count(l.ref) AS found, min(rank) AS first_rank FROM truth LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) l USING (query_id, ref) GROUP BY query_id)
    SELECT query_id, must, found, round(found / must, 6) AS recall_at_10, round(coalesce(1.0 / first_rank, 0), 6) AS mrr_at_10 FROM hit""")  # fmt: skip
def bm25_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and reciprocal rank of the lexical leg; the truth is which documents hold an item verbatim."""
    truth = held_verbatim(spark, sf_dir)
    hits = truth.join(lexical(spark, sf_dir, 10).select("query_id", "ref", "rank"), ["query_id", "ref"], "left")
    out = hits.groupBy("query_id").agg(F.count("*").alias("must"), F.count("rank").alias("found"), F.min("rank").alias("r"))
    return out.select("query_id", "must", "found", F.round(F.col("found") / F.col("must"), 6).alias("recall_at_10"), F.round(F.coalesce(F.lit(1.0) / F.col("r"), F.lit(0.0)), 6).alias("mrr_at_10"))


@query("vector_topk", f"WITH {COSINE_SQL} SELECT query_id, rank, ref, round(score, 6) AS score FROM vec WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(vectors(spark, sf_dir, k=10), 10).select("query_id", F.col("rank").cast("long").alias("rank"), "ref", F.round("score", 6).alias("score"))


_WEIGHTED = f"""
    l AS (SELECT item_id AS query_id, {LANGUAGE_SQL} AS code FROM (SELECT item_id, {COUNTS_SQL} FROM benchmark)),
    w AS (SELECT query_id, CASE WHEN code IS NOT NULL AND code <> 'en' THEN 0.1 ELSE 1.0 END AS weight FROM l)"""
_FUSED = """
    f AS (SELECT query_id, ref, lex.rank AS lexical_rank, v.rank AS vector_rank, round(coalesce(weight / (60 + lex.rank), 0) + coalesce(1.0 / (60 + v.rank), 0), 12) AS score
          FROM lex FULL JOIN (SELECT * FROM vec WHERE query_id IN (SELECT item_id FROM benchmark)) v USING (query_id, ref) JOIN w USING (query_id)),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref) AS rank FROM f)"""


def fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Lexical ranks of the items fused with the ranks of the vectors of the same ids, discounted where an item's language isn't the corpus's (English)."""
    items = _questions(spark, sf_dir)
    weights = items.select("query_id", R.language_weight(T.language(F.col("text")), F.lit("en")).alias("weight"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vector"))
    own = rows.where("ref % 50 = 0").select(F.col("ref").alias("query_id"), "vector")
    return fusion.fused(index(spark, sf_dir), rows, items.join(own, "query_id", "left"), weights, k)


@query("rrf_fusion", f"""WITH {BM25_SQL}, {COSINE_SQL}, {_WEIGHTED}, {_FUSED}
    SELECT query_id, rank, ref, lexical_rank, vector_rank, CASE WHEN vector_rank IS NULL THEN 'bm25' WHEN lexical_rank IS NULL THEN 'vector' ELSE 'both' END AS via, round(score, 9) AS score FROM fused WHERE rank <= 20""")  # fmt: skip
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long").alias(c)
    return fused(spark, sf_dir, 20).select("query_id", long("rank"), "ref", long("lexical_rank"), long("vector_rank"), "via", F.round("score", 9).alias("score"))


@query("budget_truncation", f"""WITH {BM25_SQL},
    p AS (SELECT query_id, ref, rank, text, coalesce(sum(least(length(text), 500)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
          FROM lex JOIN (SELECT doc_id AS ref, text FROM documents) USING (ref) WHERE rank <= 50)
    SELECT query_id, ref, rank, substr(text, 1, least(500, 4100 - prior)::BIGINT) AS snippet FROM p WHERE prior < 4100""")  # fmt: skip
def budget_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lexical(spark, sf_dir, 50).join(_passages(spark, sf_dir), "ref")
    return R.truncate(top, 50, 4100).select("query_id", "ref", F.col("rank").cast("long").alias("rank"), "snippet")


_PASSAGES = f"""
    cd AS (SELECT conv_id, turn, {_TOKENS} AS t FROM conversations), cq AS (SELECT item_id AS query_id, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
    cm AS (SELECT query_id, conv_id, turn, count(*) AS hits FROM (SELECT conv_id, turn, unnest(t) AS term FROM cd) JOIN cq USING (term) GROUP BY ALL),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, conv_id, turn) AS rank FROM cm),
    docs AS (SELECT query_id, conv_id, min(rank) AS first_rank FROM cr GROUP BY ALL),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_rank, conv_id) AS drank FROM docs)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns ranked by the number of query tokens they hold: passages of documents of more than one."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.tokens(F.col("text"))).alias("term"))
    hits = turns.join(R.query_terms(_questions(spark, sf_dir)), "term").groupBy("query_id", "conv_id", "turn").agg(F.count("*").alias("score"))
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "conv_id", "turn")))


@query("document_order", f"WITH {_PASSAGES} SELECT query_id, conv_id, first_rank, drank AS rank FROM dr WHERE drank <= 10")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best passage."""
    return R.documents_of(_turns(spark, sf_dir), "conv_id", 10).select("query_id", "conv_id", F.col("first_rank").cast("long").alias("first_rank"), F.col("rank").cast("long").alias("rank"))


@query("rerank_interleave", f"""WITH {_PASSAGES},
    nr AS (SELECT query_id, conv_id, row_number() OVER (PARTITION BY query_id ORDER BY drank DESC) AS new_rank FROM dr WHERE drank <= 40),
    x AS (SELECT c.query_id, c.conv_id, c.turn, c.rank, new_rank, row_number() OVER (PARTITION BY c.query_id, c.conv_id ORDER BY c.rank) - 1 AS i FROM cr c LEFT JOIN nr USING (query_id, conv_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY new_rank IS NULL, CASE WHEN new_rank IS NULL THEN 0 ELSE i END, coalesce(new_rank, rank), conv_id, turn) AS final_rank FROM x)
    SELECT query_id, conv_id, turn, rank, final_rank FROM o WHERE final_rank <= 60""")  # fmt: skip
def rerank_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scorer that turns the head of 40 documents around; membership stays, passages interleave."""
    from pyspark.sql import Window

    turns = _turns(spark, sf_dir).select("query_id", F.struct("conv_id", "turn").alias("ref"), F.col("conv_id").alias("document_ref"), "rank")
    head = R.documents_of(turns).where(F.col("rank") <= R.RERANK_DEPTH)
    order = head.select("query_id", "document_ref", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"))).alias("new_rank"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return R.interleave(turns, order).where("final_rank <= 60").select("query_id", "ref.conv_id", "ref.turn", long("rank"), long("final_rank"))


@query("leg_notes", f"""WITH {BM25_SQL}, {COSINE_SQL}
    SELECT item_id AS query_id, array_to_string(list_filter([CASE WHEN item_id NOT IN (SELECT query_id FROM lex) THEN 'lexical_leg_no_matches' END, CASE WHEN item_id NOT IN (SELECT query_id FROM vec) THEN 'vector_leg_no_matches' END], lambda n: n IS NOT NULL), ',') AS notes,
           CASE WHEN item_id NOT IN (SELECT query_id FROM lex) OR item_id NOT IN (SELECT query_id FROM vec) THEN 'partial' ELSE 'complete' END AS status FROM benchmark""")  # fmt: skip
def leg_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vector"))
    # a term that some passage holds is a match, a vector that can be compared finds one: nothing is scored
    own = R.comparable(rows, rows.where("ref % 50 = 0").select(F.col("ref").alias("query_id"), "vector"))
    out = R.leg_notes(questions, L.asked(index(spark, sf_dir), questions), own)
    return out.select("query_id", F.array_join("notes", ",").alias("notes"), "status")
