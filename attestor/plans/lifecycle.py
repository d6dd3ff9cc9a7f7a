"""Index lifecycle and pair mining over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attestor.operators import lifecycle as L
from attestor.plans.catalog import query, read


def _generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """This build's passages and the last one's: every seventh text was another, every eleventh document is new."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    old = d.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("doc_id") % 7 == 0, F.lit("changed")).otherwise(F.col("hash")))
    return d, old


_GEN = """d AS (SELECT doc_id, source, sha256(text) AS hash FROM documents), o AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 0 THEN 'changed' ELSE hash END AS hash FROM d WHERE doc_id % 11 <> 0)"""


@query("incremental_reuse", f"WITH {_GEN} SELECT doc_id, EXISTS (SELECT 1 FROM o WHERE o.doc_id = d.doc_id AND o.source = d.source AND o.hash = d.hash) AS reused FROM d")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, made = L.reusable(*_generations(spark, sf_dir), ["doc_id", "source", "hash"])
    return kept.select("doc_id", F.lit(True).alias("reused")).unionByName(made.select("doc_id", F.lit(False).alias("reused")))


@query("generation_diff", f"WITH {_GEN} SELECT doc_id, source, hash, 'left' AS side FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM o) UNION ALL SELECT doc_id, source, hash, 'right' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM d)")
def generation_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate validation: empty if two generations hold the same rows."""
    return L.differences(*_generations(spark, sf_dir)).select("doc_id", "source", "hash", "side")


@query("orphan_passages", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)")
def orphan_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without a parent: the foreign-key check."""
    return L.orphans(read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents").where("doc_id % 5 <> 0"), "doc_id").select("doc_id", "quality")


@query("alias_resolution", "SELECT doc_id AS ref, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN doc_id + 1000000 ELSE doc_id END AS resolved FROM documents")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"))
    return L.resolve_aliases(refs, refs.where("ref % 4 = 0").withColumn("target", F.col("ref") + 1_000_000), refs.where("ref % 9 = 0"))


@query("unreferenced_generations", """WITH g AS (SELECT 'gen-' || lower(o_orderstatus) || '-' || (o_custkey % 50) AS name, o_custkey % 6 = 0 AS active FROM orders)
    SELECT DISTINCT name FROM g WHERE regexp_matches(name, '^gen-[of]-\\d+$') AND name NOT IN (SELECT name FROM g WHERE active)""")  # fmt: skip
def unreferenced_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations that no pointer names and whose name is one that a build gives: what pruning may delete."""
    g = read(spark, sf_dir, "orders").select(F.concat_ws("-", F.lit("gen"), F.lower("o_orderstatus"), F.col("o_custkey") % 50).alias("name"), (F.col("o_custkey") % 6 == 0).alias("active"))
    return g.where(F.col("name").rlike(r"^gen-[of]-\d+$")).select("name").distinct().join(g.where("active").select("name"), "name", "left_anti")


_PAIR = """
    c AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 25 = 0 THEN -1 - o_orderkey ELSE o_custkey END AS issue, 'Customer ' || (o_custkey % 17) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'user' || (o_custkey % 17) END AS login, o_orderdate AS ats FROM orders),
    i AS (SELECT c_custkey AS issue, 'user' || (c_custkey % 17) AS login, TIMESTAMP '1995-01-01' + to_days((c_custkey * 29 % 900)::INT) AS ats, c_custkey % 10 = 0 AS pull FROM customer),
    j AS (SELECT c.sha, c.issue, CASE WHEN i.issue IS NULL THEN 'unknown_issue' WHEN pull THEN 'pull_request' WHEN c.login = i.login THEN 'same_author' WHEN i.ats >= c.ats THEN 'issue_not_earlier' END AS reason, c.ats FROM c LEFT JOIN i USING (issue))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits that close an issue, their customers as issues; some close one that nobody knows."""
    n = F.col("o_custkey") % 17
    c = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.when(F.col("o_orderkey") % 25 == 0, -1 - F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("issue"), F.concat(F.lit("Customer "), n).alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("user"), n)).alias("login"), F.col("o_orderdate").alias("authored_at"))
    k = F.col("c_custkey")
    i = read(spark, sf_dir, "customer").select(k.alias("issue"), F.concat(F.lit("user"), k % 17).alias("issue_login"), (F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((k * 29 % 900).cast("int"))).alias("created_at"), (k % 10 == 0).alias("pull"))
    rows = c.join(i, "issue", "left")
    reason = F.when(F.col("issue_login").isNull(), "unknown_issue").otherwise(L.independence(F.col("login"), F.col("issue_login"), F.col("name"), F.col("authored_at"), F.col("created_at"), F.col("pull")))
    return rows.withColumn("reason", reason)


@query("rejection_tally", f"WITH {_PAIR} SELECT reason, count(*) AS pairs FROM j WHERE reason IS NOT NULL GROUP BY reason")
def rejection_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("pairs"))


@query("issue_answers", f"WITH {_PAIR}, k AS (SELECT issue, sha, ats, row_number() OVER (PARTITION BY issue ORDER BY ats, sha) AS r FROM j WHERE reason IS NULL) SELECT issue, max(sha) FILTER (r = 1) AS sha, coalesce(string_agg(sha::VARCHAR, ',' ORDER BY r) FILTER (r > 1), '') AS also_answered_by FROM k GROUP BY issue")
def issue_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.answers(_pairs(spark, sf_dir).where("reason IS NULL").select("issue", "authored_at", "sha"))
    return out.select("issue", "sha", F.array_join(F.transform("also_answered_by", lambda s: s.cast("string")), ",").alias("also_answered_by"))


@query("evidence_ceiling", """WITH l AS (SELECT l_orderkey AS o, l_partkey AS ref, 0 AS leg, l_linenumber AS pos FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_partkey, 1, l_linenumber FROM lineitem WHERE l_quantity < 30 UNION ALL SELECT l_orderkey, l_suppkey, 2, l_linenumber FROM lineitem),
    u AS (SELECT o, ref, min({'leg': leg, 'pos': pos}) AS k FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY k.leg, k.pos, ref) AS rank FROM u) SELECT o AS order_key, ref, k.leg AS leg, rank FROM r WHERE rank <= 4""")  # fmt: skip
def evidence_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    leg = lambda df, ref: df.select(F.col("l_orderkey").alias("order_key"), F.col(ref).alias("ref"), F.col("l_linenumber").alias("pos"))
    out = L.ceiling([leg(line.where("l_returnflag = 'R'"), "l_partkey"), leg(line.where("l_quantity < 30"), "l_partkey"), leg(line, "l_suppkey")], 4, "order_key", 2 * line.count())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("acknowledgments", """WITH p AS (SELECT o_orderkey, [x FOR x IN range(o_orderkey % 4, o_orderkey % 4 + 3)] AS rq, [x FOR x IN range(o_custkey % 5, o_custkey % 5 + 2)] AS fr FROM orders)
    SELECT o_orderkey, array_to_string(list_filter(rq, lambda x: NOT list_contains(fr, x)), ',') AS missing, array_to_string(list_filter(fr, lambda x: NOT list_contains(rq, x)), ',') AS unexpected FROM p""")  # fmt: skip
def acknowledgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda c, m, n: F.sequence(F.col(c) % m, F.col(c) % m + n - 1)
    out = read(spark, sf_dir, "orders").select("o_orderkey", L.acknowledgments(span("o_orderkey", 4, 3), span("o_custkey", 5, 2)).alias("a"))
    text = lambda c: F.array_join(F.transform(f"a.{c}", lambda x: x.cast("string")), ",").alias(c)
    return out.select("o_orderkey", text("missing"), text("unexpected"))


@query("corpus_coverage", "SELECT source, count(*) AS examined, count(*) FILTER (length(trim(text)) > 200) AS written, round(count(*) FILTER (length(trim(text)) > 200) / count(*), 6) AS coverage FROM documents GROUP BY source")
def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the commits examined, those whose body is worth a document."""
    body = F.length(F.trim("text")) > 200
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("examined"), F.count_if(body).alias("written"), F.round(F.count_if(body) / F.count("*"), 6).alias("coverage"))


@query("touched_files", "SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:3], ',') AS files FROM lineitem GROUP BY l_orderkey")
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's files, each once and in order, the first few."""
    out = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 3).alias("f"))
    return out.select("l_orderkey", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("files"))


@query("database_fingerprint", """WITH r AS (SELECT lang, substr(sha256(doc_id || ''), 1, 4) AS bucket, sha256(doc_id || chr(0) || text) AS h, doc_id FROM documents),
    b AS (SELECT lang, bucket, count(*) AS docs, sha256(string_agg(h, '' ORDER BY doc_id)) AS h FROM r GROUP BY ALL)
    SELECT lang, sum(docs)::BIGINT AS docs, sha256(string_agg(bucket || h, '' ORDER BY bucket)) AS fingerprint FROM b GROUP BY lang""")  # fmt: skip
def database_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a hash over rows, in two levels so that no task gathers more than a bucket's hashes."""
    id_ = F.col("doc_id").cast("string")
    rows = read(spark, sf_dir, "documents").select("lang", id_.alias("key"), F.struct("doc_id", F.sha2(F.concat(id_, F.lit("\0"), F.col("text")), 256).alias("h")).alias("line"))
    return L.layered_digest(rows, "lang", F.col("line.h"), "docs", "fingerprint")


@query("registry_order", """WITH d AS (SELECT p_partkey, p_brand, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
    SELECT p_partkey, p_brand, p_size, n > 1 AS collides, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS position FROM d WHERE r = 1""")  # fmt: skip
def registry_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of each (pack, source), whether another claims its name, and its place in the pack."""
    key = Window.partitionBy("p_brand", "p_size")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.row_number().over(key.orderBy("p_partkey")).alias("r"), (F.count("*").over(key) > 1).alias("collides"))
    return rows.where("r = 1").select("p_partkey", "p_brand", "p_size", "collides", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("position"))
