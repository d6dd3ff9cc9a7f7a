"""Cache and audit upkeep, evaluation runs and index checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.operators import maintenance as M, runs as U
from attestor.plans import retrieval as plans
from attestor.plans.catalog import query, read
from attestor.sources.policy import Policy

_NOW = "2024-01-15 00:00:00"
_CACHE = """c AS (SELECT event_id AS cache_key, user_id, event_type, 'live-' || (event_id % 97) AS ref, floor(value)::BIGINT + 1 AS bytes, date_trunc('second', ts) AS retrieved_at, CASE WHEN event_id % 10 <> 3 THEN date_trunc('second', ts) + (event_id % 40) * INTERVAL 12 HOUR END AS expires_at FROM events)"""


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    expires = F.when(F.col("event_id") % 10 != 3, F.timestamp_seconds(F.unix_timestamp(at) + (F.col("event_id") % 40) * 43_200))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("cache_key"), "user_id", "event_type", F.concat(F.lit("live-"), F.col("event_id") % 97).alias("ref"), (F.floor("value") + 1).cast("long").alias("bytes"), at.alias("retrieved_at"), expires.alias("expires_at"))


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


@query("cache_stats", f"WITH {_CACHE} SELECT event_type, count(*) AS entries, count(*) FILTER (expires_at < TIMESTAMP '{_NOW}') AS expired, sum(bytes)::BIGINT AS total_bytes FROM c GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stats(_cache(spark, sf_dir), _now(), "event_type")


@query("cache_prune", f"""WITH {_CACHE}, g AS (SELECT *, expires_at IS NULL OR expires_at < TIMESTAMP '{_NOW}' OR expires_at > TIMESTAMP '{_NOW}' + INTERVAL 5 DAY AS gone FROM c)
    SELECT event_type, count(*) AS scanned, count(*) FILTER (gone) AS removed, count(*) FILTER (expires_at IS NULL) AS corrupt, sum(CASE WHEN gone THEN bytes ELSE 0 END)::BIGINT AS bytes_reclaimed FROM g GROUP BY 1""")  # fmt: skip
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.prune_summary(_cache(spark, sf_dir), _now(), 5 * 86_400, "event_type")


@query("cache_by_ref", f"""WITH {_CACHE}, r AS (SELECT DISTINCT 'live-' || (event_id % 120) AS ref FROM events), k AS (SELECT ref, arg_min(expires_at, cache_key) AS expires_at, min(cache_key) AS cache_key FROM c WHERE expires_at IS NOT NULL GROUP BY 1)
    SELECT ref, CASE WHEN expires_at >= TIMESTAMP '{_NOW}' THEN cache_key END AS cache_key, CASE WHEN expires_at IS NULL THEN 'miss' WHEN expires_at < TIMESTAMP '{_NOW}' THEN 'expired' ELSE 'hit' END AS state FROM r LEFT JOIN k USING (ref)""")  # fmt: skip
def cache_by_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entry answers for a reference."""
    refs = read(spark, sf_dir, "events").select(F.concat(F.lit("live-"), F.col("event_id") % 120).alias("ref"))
    return M.by_ref(refs, _cache(spark, sf_dir), _now())


@query("cache_writes", f"""WITH {_CACHE}, w AS (SELECT user_id, cache_key, cache_key AS seq, retrieved_at, expires_at, (cache_key % 2)::INT AS new FROM c), t AS (SELECT max(retrieved_at) AS clock FROM w WHERE new = 1),
    l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY new DESC, seq DESC) AS r FROM w) SELECT user_id, seq FROM l, t WHERE r = 1 AND (expires_at IS NULL OR NOT clock > expires_at)""")  # fmt: skip
def cache_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd events are written over the entries of even ones, a key per user; what has expired by then goes."""
    rows = _cache(spark, sf_dir).select(F.col("user_id").alias("cache_key"), F.col("cache_key").alias("seq"), "retrieved_at", "expires_at")
    return M.written(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")).select(F.col("cache_key").alias("user_id"), "seq")


@query("live_refs", "SELECT page_id, 'live:sha256:' || substr(sha256(html), 1, 32) AS ref FROM pages")
def live_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", M.live_ref(F.col("html")).alias("ref"))


@query("budget_allowance", """WITH p AS (SELECT c_custkey, c_custkey % 6 AS rl, floor(c_acctbal)::BIGINT AS bl, c_custkey % 9 * 100 AS ml FROM customer), d AS (SELECT *, rl >= 1 AND bl >= 1024 AND ml >= 1 AS funded FROM p)
    SELECT c_custkey, CASE WHEN funded THEN least(3, rl) END AS requests, CASE WHEN funded THEN least(4096, bl) END AS bytes, CASE WHEN funded THEN least(500, ml) END AS ms, funded FROM d""")  # fmt: skip
def budget_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared budget narrowed to what a pool has left, or nothing below its floors."""
    k = F.col("c_custkey")
    pool = read(spark, sf_dir, "customer").select("c_custkey", (k % 6).alias("requests_left"), F.floor("c_acctbal").cast("long").alias("bytes_left"), (k % 9 * 100).alias("ms_left"), F.lit(3).cast("long").alias("max_requests"), F.lit(4096).cast("long").alias("max_bytes"), F.lit(500).cast("long").alias("max_ms"))
    return M.allowance(pool)


@query("audit_trail", "SELECT event_type AS decision, count(*) AS calls, sum(event_id)::BIGINT AS elapsed FROM events GROUP BY 1")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended in two runs and read back."""
    records = read(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("request_id"), F.lit("example.org").alias("destination_host"), F.lit("public_https").alias("destination_class"), F.col("event_type").alias("decision"), F.lit("ok").alias("code"),
        F.lit(None).cast("long").alias("bytes_transferred"), F.col("event_id").alias("elapsed_ms"), F.col("ts").cast("string").alias("timestamp"),
    )
    path = scratch.new_path(spark, "audit")
    M.append_audit(records.where("elapsed_ms % 2 = 0"), path)
    M.append_audit(records.where("elapsed_ms % 2 = 1"), path)
    return M.read_audit(spark, path).groupBy("decision").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("elapsed"))


@query("resumed_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run over all orders appends after a first one that had come through a third of them."""
    rows, path = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), scratch.new_path(spark, "run")
    M.append_new(rows.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    return M.append_new(rows, path, "o_orderkey")


@query("question_file", "SELECT 'q' || item_id AS id, text AS query, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'es' END AS language, 1 + item_id % 2 AS must FROM benchmark")
def question_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as a file of questions and read back under its schema."""
    path = scratch.new_path(spark, "questions")
    odd = F.col("item_id") % 2 == 1
    truth = F.struct(F.when(odd, F.array(F.lit("a.md"), F.lit("b.md"))).otherwise(F.array(F.lit("a.md"))).alias("must_include"), F.array().cast("array<string>").alias("acceptable"))
    read(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), "item_id").alias("id"), F.col("text").alias("query"), F.when(odd, "es").otherwise("en").alias("language"), F.lit("fact").alias("type"), truth.alias("ground_truth")).write.json(path)
    return U.questions(spark, path).select("id", "query", "language", F.size("must_include").cast("long").alias("must"))


@query("first_correct", f"""WITH {plans.BM25_SQL}, t AS (SELECT query_id, (query_id * 7 + k) % 200 AS ref FROM (SELECT item_id AS query_id FROM benchmark), (VALUES (0), (1), (2)) v(k))
    SELECT query_id, (SELECT arg_min(ref, rank) FROM lex l WHERE l.query_id = t.query_id AND rank <= 10) AS top1, min(rank) AS first_correct_rank FROM t LEFT JOIN (SELECT * FROM lex WHERE rank <= 10) USING (query_id, ref) GROUP BY query_id""")  # fmt: skip
def first_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rank at which one of a question's answers comes."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    truth = items.select("query_id", F.explode(F.array(*(((F.col("query_id") * 7 + k) % 200) for k in range(3)))).alias("document"))
    ranking = plans.lexical(spark, sf_dir, 10).select("query_id", F.col("ref").alias("document"), F.col("rank").cast("long").alias("rank"))
    return U.first_correct(ranking, truth)


@query("answer_present", "SELECT o_orderkey AS query_id, bool_or(o_custkey * 2 IN (SELECT p_partkey FROM part)) AS present FROM orders GROUP BY 1")
def answer_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") * 2).alias("document"))
    return U.answer_present(truth, read(spark, sf_dir, "part").select(F.col("p_partkey").alias("document")))


@query("answer_rank", f"WITH {plans._PASSAGES} SELECT item_id AS query_id, min(drank) AS rank FROM benchmark LEFT JOIN dr ON dr.query_id = item_id AND conv_id = item_id % 15 GROUP BY 1")
def answer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the answer among all documents, without a budget; a document's place follows its best passage."""
    turns = plans._turns(spark, sf_dir).select("query_id", F.col("conv_id").alias("document"), F.col("rank").cast("long").alias("rank"))
    truth = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 15).alias("document"))
    return U.answer_rank(turns, truth)


_SETS = """p AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS d FROM lineitem WHERE l_returnflag <> 'R'), s AS (SELECT DISTINCT l_orderkey AS q, l_partkey % 20 AS d FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber > 2),
    m AS (SELECT coalesce(p.q, s.q) AS query_id, list_sort(coalesce(list(p.d) FILTER (s.d IS NULL), [])) AS dropped, list_sort(coalesce(list(s.d) FILTER (p.d IS NULL), [])) AS added FROM p FULL JOIN s ON p.q = s.q AND p.d = s.d GROUP BY 1)"""


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "lineitem")
    pairs = lambda cond: rows.where(cond).select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 20).alias("document"))
    return pairs("l_returnflag <> 'R'"), pairs("l_returnflag <> 'A' OR l_linenumber > 2")


@query("result_membership", f"WITH {_SETS} SELECT query_id, array_to_string(dropped, ',') AS dropped, array_to_string(added, ',') AS added FROM m")
def result_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that only one of two result sets holds."""
    out = U.membership(*_sets(spark, sf_dir))
    return out.select("query_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("dropped", "added")))


@query("identity_summary", f"""WITH {_SETS}, r AS (SELECT m.*, o_orderpriority, NULLIF(o_orderkey % 7, 0) AS plain_rank, NULLIF(o_orderkey % 5, 0) AS staged_rank FROM m JOIN orders ON o_orderkey = query_id)
    SELECT o_orderpriority, count(*) AS questions, count(*) FILTER (len(dropped) > 0 OR len(added) > 0) AS membership_changed, count(*) FILTER (plain_rank IS NOT NULL AND staged_rank IS NULL) AS answers_dropped, count(*) FILTER (plain_rank <> staged_rank) AS rank_moved,
           round(avg(len(dropped)), 6) AS plain_documents, round(avg(len(added)), 6) AS staged_documents FROM r GROUP BY 1""")  # fmt: skip
def identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage that should change nothing has changed."""
    k = F.col("o_orderkey")
    rows = U.membership(*_sets(spark, sf_dir)).join(read(spark, sf_dir, "orders"), F.col("query_id") == k)
    rows = rows.select("o_orderpriority", "dropped", "added", F.nullif(k % 7, F.lit(0)).alias("plain_rank"), F.nullif(k % 5, F.lit(0)).alias("staged_rank"), F.size("dropped").alias("plain_documents"), F.size("added").alias("staged_documents"))
    out = U.identity_summary(rows, "o_orderpriority")
    return out.withColumn("plain_documents", F.round("plain_documents", 6)).withColumn("staged_documents", F.round("staged_documents", 6))


@query("restatement", """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS rank FROM events)
    SELECT user_id, event_id, rank, 'shipped' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT user_id, event_id, rank, 'restated' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")  # fmt: skip
def restatement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a ranking by rounded scores departs from that by the scores themselves."""
    from pyspark.sql import Window

    ranked = lambda score: read(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(score.desc(), "event_id")).cast("long").alias("rank"))
    return U.restated(ranked(F.col("value")), ranked(F.floor("value")), ["user_id", "event_id", "rank"])


@query("gate_matrix", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS not_validated FROM orders GROUP BY 1")
def gate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    cells = read(spark, sf_dir, "orders").select("o_orderpriority", F.when(s == "F", "pass").when(s == "O", "fail").otherwise("not_validated").alias("status"))
    return U.gates(cells, "o_orderpriority")


@query("scale_percentiles", """WITH r AS (SELECT event_type, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS runs, round(median(ms), 6) AS p50, max(ms) FILTER (i = floor(n * 0.95)) AS p95 FROM r GROUP BY 1""")  # fmt: skip
def scale_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = U.scale(read(spark, sf_dir, "events").select("event_type", F.col("value").alias("ms")), "event_type")
    return out.withColumn("p50", F.round("p50", 6))


@query("unrepresented_passages", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') OR l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)")
def unrepresented_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that lack their document or their line of the manifest."""
    rows = read(spark, sf_dir, "lineitem")
    passages = rows.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("ref"), F.col("l_orderkey").alias("document_ref"), F.col("l_partkey").alias("path"))
    documents, manifest = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_ref")), read(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("path"))
    return U.unrepresented(passages, documents, manifest).select("ref.l_orderkey", "ref.l_linenumber", "ref.l_partkey")


@query("heading_paths", """SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_name || '>' || p_type WHEN p_partkey % 6 = 2 THEN '' END AS path FROM part""")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored heading paths decoded; what isn't a list of strings is null, never a plausible path."""
    k = F.col("p_partkey")
    raw = F.when(k % 6 < 2, F.to_json(F.array("p_name", "p_type"))).when(k % 6 == 2, "[]").when(k % 6 == 3, "5").when(k % 6 == 4, '{"a": 1}').otherwise('["a", 1]')
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(U.heading_path(raw), ">").alias("path"))


@query("cursor_checks", """SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN turn * 10 END AS position, CASE WHEN turn % 4 = 2 THEN 'cursor_mismatch' WHEN turn % 4 = 3 THEN 'malformed_cursor' END AS code FROM conversations""")
def cursor_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors read back: for this request and reference, for others, and broken ones."""
    request, ref, turn = F.concat(F.lit("r"), "conv_id"), F.concat(F.lit("p"), "turn"), F.col("turn")
    made = F.when(turn % 4 == 3, "not a cursor").otherwise(U.cursor(F.when(turn % 4 == 2, "another").otherwise(request), ref, turn * 10))
    pages = read(spark, sf_dir, "conversations").select("conv_id", "turn", made.alias("cursor"), request.alias("request_id"), ref.alias("ref"))
    return U.cursors(pages).select("conv_id", "turn", "position", "code")


_POLICY = Policy(("docs/*.md", "notes/[a-m]*"), ("docs/draft*",))


@query("policy_reasons", """WITH f AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'docs/' || p_name || '.md' WHEN 1 THEN 'docs/draft-' || p_partkey || '.md' WHEN 2 THEN 'notes/' || p_name WHEN 3 THEN 'docs/Archive/x.md' WHEN 4 THEN 'docs/.git/x.md' WHEN 5 THEN '../docs/x.md' WHEN 6 THEN '/docs/x.md' ELSE 'src/' || p_name || '.md' END AS path, p_name FROM part)
    SELECT p_partkey, path, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 2 THEN CASE WHEN p_name[1] BETWEEN 'a' AND 'm' THEN NULL ELSE 'not_allowlisted' END WHEN 5 THEN 'outside_approved_root' WHEN 6 THEN 'outside_approved_root' WHEN 7 THEN 'not_allowlisted' ELSE 'excluded_by_policy' END AS reason FROM f""")  # fmt: skip
def policy_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file isn't in the corpus."""
    k, n = F.col("p_partkey"), F.col("p_name")
    path = F.when(k % 8 == 0, F.concat(F.lit("docs/"), n, F.lit(".md"))).when(k % 8 == 1, F.concat(F.lit("docs/draft-"), k, F.lit(".md"))).when(k % 8 == 2, F.concat(F.lit("notes/"), n)).when(k % 8 == 3, "docs/Archive/x.md")
    path = path.when(k % 8 == 4, "docs/.git/x.md").when(k % 8 == 5, "../docs/x.md").when(k % 8 == 6, "/docs/x.md").otherwise(F.concat(F.lit("src/"), n, F.lit(".md")))
    return read(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("reason", _POLICY.reason(F.col("path")))


@query("note_labels", """WITH r AS (SELECT user_id AS query_id, event_id % 7 AS document, event_type AS via, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events),
    b AS (SELECT query_id, document, min(rank) AS first, arg_min(via, rank) AS via FROM r GROUP BY ALL) SELECT query_id, document, row_number() OVER (PARTITION BY query_id ORDER BY first) AS rank, via FROM b""")  # fmt: skip
def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a fused ranking, each with the label of its best passage."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    ranking = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 7).alias("document"), F.col("event_type").alias("via"), place.alias("rank"))
    return U.notes(ranking).withColumn("rank", F.col("rank").cast("long"))


@query("report_lines", """WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS not_validated FROM orders GROUP BY 1)
    SELECT 0 AS line, '| o_orderpriority | passed | failed | not_validated |' AS text UNION ALL SELECT 1, '| --- | --- | --- | --- |' UNION ALL SELECT (row_number() OVER (ORDER BY o_orderpriority) + 1)::INT, '| ' || o_orderpriority || ' | ' || passed || ' | ' || failed || ' | ' || not_validated || ' |' FROM g""")  # fmt: skip
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate matrix as a markdown table."""
    return U.report(gate_matrix(spark, sf_dir), "o_orderpriority")
