"""Live-evidence operators over events (calls and cache entries) and pages (URLs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.functions import text as T
from attestor.operators import research as R
from attestor.plans.catalog import query, read

_HOSTS = ("example.org", "example.com", "www.example.net")
_URLS = "https://' || ['example.org', 'example.com', 'www.example.net', 'other.test'][event_id % 4 + 1] || CASE WHEN event_id % 5 = 0 THEN '/private/' ELSE '/p/' END || user_id"
_EV = f"""ev AS (SELECT *, CASE WHEN event_id % 9 <> 0 THEN '{_URLS} END AS url, ['example.org', 'example.com', 'www.example.net', 'other.test'][event_id % 4 + 1] AS host, floor(value * 10)::BIGINT + 500 AS bytes FROM events)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = F.array(*map(F.lit, (*_HOSTS, "other.test")))
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    url = F.concat(F.lit("https://"), F.element_at(hosts, (F.col("event_id") % 4 + 1).cast("int")), F.when(F.col("event_id") % 5 == 0, "/private/").otherwise("/p/"), F.col("user_id"))
    return e.withColumn("url", F.when(F.col("event_id") % 9 != 0, url)).withColumn("bytes", F.floor(F.col("value") * 10).cast("long") + 500)


@query("budget_ledger", f"""WITH {_EV}, p AS (SELECT event_id, user_id, bytes, event_type = 'view' AS cached, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER w AS rq, sum(CASE WHEN event_type = 'view' THEN 0 ELSE bytes END) OVER w AS by_ FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT *, greatest(10 - coalesce(rq, 0), 0)::BIGINT AS requests_left, greatest(9000 - coalesce(by_, 0), 0)::BIGINT AS bytes_left FROM p)
    SELECT event_id, requests_left, bytes_left, CASE WHEN cached THEN 'cached' WHEN requests_left < 1 OR bytes_left < 1024 THEN 'network_budget_exhausted' ELSE 'fetch' END AS decision FROM l""")  # fmt: skip
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("investigation"), F.struct("ts", "event_id").alias("seq"), "bytes", (F.col("event_type") == "view").alias("cached"))
    return R.ledger(calls, 10, 9000).select("event_id", F.col("requests_left").cast("long").alias("requests_left"), F.col("bytes_left").cast("long").alias("bytes_left"), "decision")


_NOW, _TTL = "2024-01-15 00:00:00", 86_400


@query("cache_state", f"""WITH x AS (SELECT user_id, event_id, ts + INTERVAL 36 HOUR AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
    s AS (SELECT *, epoch(expires_at)::BIGINT - epoch((SELECT max(ts) FROM events))::BIGINT AS lft FROM x WHERE r = 1)
    SELECT user_id, event_id, CASE WHEN lft < 0 THEN 'expired' WHEN lft > {_TTL} THEN 'implausible' ELSE 'hit' END AS state FROM s""")  # fmt: skip
def cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key: what a read at the time of the newest event finds."""
    e = _events(spark, sf_dir)
    now = e.agg(F.max("at").alias("now"))
    entries = R.latest(e, "user_id", [F.desc("ts"), F.desc("event_id")]).crossJoin(F.broadcast(now)).withColumn("expires_at", F.col("at") + F.expr("INTERVAL 36 HOURS"))
    return entries.select("user_id", "event_id", R.cache_state(entries, F.date_trunc("second", F.col("now")), _TTL).alias("state"))


@query("research_ladder", f"""WITH {_EV}, d AS (SELECT *, CASE WHEN event_type = 'error' OR user_id % 10 = 0 THEN 'network_disabled' WHEN url IS NULL THEN 'no_candidate_url' WHEN event_id % 13 = 0 THEN 'network_budget_exhausted' WHEN host NOT IN ('example.org', 'example.com') THEN 'host_not_allowlisted'
        WHEN host = 'example.org' AND regexp_extract(url, '^[^:]*://[^/]*(.*)$', 1) LIKE '/private/%' THEN 'access_restricted' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'cached' ELSE 'fetch' END AS code FROM ev)
    SELECT event_id, code, CASE WHEN code = 'network_disabled' THEN 'disabled' WHEN code IN ('host_not_allowlisted', 'access_restricted') THEN 'blocked' ELSE 'error' END AS status_if_failed FROM d""")  # fmt: skip
def research_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call's decision: admission comes before the cache, and a cached answer of another policy doesn't count."""
    e = _events(spark, sf_dir)
    allowed = F.array(F.lit("example.org"), F.lit("example.com:443"))
    r = e.select(
        "event_id", "url", T.host(F.col("url")).alias("host"), T.path(F.col("url")).alias("path"), (F.col("event_type") != "error").alias("enabled"), F.when(F.col("user_id") % 10 == 0, "none").otherwise("public_https").alias("policy"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(5).alias("budget"),
        R.admitted(T.host(F.col("url")), T.port(F.col("url")), allowed).alias("allowed"), F.when(F.col("event_id") % 2 == 0, "hit").otherwise("expired").alias("cache"), F.when(F.col("event_id") % 3 == 0, "v2").otherwise("v1").alias("cached_policy"), F.lit("v2").alias("policy_version"),
    )
    denied = spark.createDataFrame([("example.org", "/private/")], "host string, prefix string")
    hit = r.join(F.broadcast(denied), R.path_denied(r, denied), "left_semi").select("event_id", F.lit(True).alias("denied"))
    r = r.join(hit, "event_id", "left").withColumn("denied", F.coalesce("denied", F.lit(False)))
    out = r.select("event_id", R.decide(r).alias("code"))
    return out.withColumn("status_if_failed", R.status_for(F.col("code")))


DEADLINE_MS = 1500
_TAKES = "(event_id * 37 % 400)::BIGINT"


def deadline_sql(order: str) -> str:
    """Charges of funded and cached calls only, a floor of a millisecond, and calls that are cut off."""
    over = f"OVER (PARTITION BY user_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    left = lambda most, c: f"greatest({most} - coalesce(sum({c}) {over}, 0), 0)::BIGINT"
    return f"""WITH c AS (SELECT event_id, user_id, ts, event_type = 'view' AS cached, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS r, CASE WHEN event_type = 'view' THEN 0 ELSE floor(value * 10)::BIGINT + 500 END AS b, {_TAKES} AS ms FROM events),
    a AS (SELECT *, {left(10, 'r')} AS lr, {left(9000, 'b')} AS lb, {left(DEADLINE_MS, 'ms')} AS lm FROM c),
    d AS (SELECT * EXCLUDE (lr, lb, lm), NOT cached AND (lr < 1 OR lb < 1024 OR lm < 1) AS denied FROM a),
    f AS (SELECT *, {left(10, 'CASE WHEN denied THEN 0 ELSE r END')} AS requests_left, {left(9000, 'CASE WHEN denied THEN 0 ELSE b END')} AS bytes_left, {left(DEADLINE_MS, 'CASE WHEN denied THEN 0 ELSE ms END')} AS ms_left FROM d)
    SELECT user_id, event_id, requests_left, bytes_left, ms_left, CASE WHEN denied THEN 0 ELSE least(ms, ms_left) END AS ms_charged, NOT cached AND NOT denied AND ms > ms_left AS timed_out,
           CASE WHEN cached THEN 'cached' WHEN denied THEN 'network_budget_exhausted' ELSE 'fetch' END AS decision, CASE WHEN NOT denied THEN NULL WHEN requests_left < 1 THEN 'requests' WHEN bytes_left < 1024 THEN 'bytes' ELSE 'time' END AS exhausted FROM f"""


@query("deadline_ledger", deadline_sql("ts, event_id"))
def deadline_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, bytes and time of each user's calls, summed by the hour."""
    calls = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).select(
        "event_id", F.col("user_id").alias("investigation"), F.struct("at", "event_id").alias("seq"), "at", (F.floor(F.col("value") * 10) + 500).cast("long").alias("bytes"), (F.col("event_id") * 37 % 400).alias("elapsed_ms"), (F.col("event_type") == "view").alias("cached"),
    )
    out = R.timed_ledger(calls, 10, 9000, DEADLINE_MS, F.date_trunc("hour", "at"))
    return out.select(F.col("investigation").alias("user_id"), "event_id", "requests_left", "bytes_left", "ms_left", "ms_charged", "timed_out", "decision", "exhausted")


@query("candidate_urls", """WITH u AS (SELECT conv_id, regexp_extract_all(string_agg(CASE turn % 3 WHEN 0 THEN 'ftp://x/' || turn ELSE 'https://h' || (turn % 4) || '/' END, ' ' ORDER BY turn), '\\S+') AS urls FROM conversations GROUP BY conv_id),
    k AS (SELECT conv_id, urls, list_filter(urls, lambda x, i: x LIKE 'http%' AND list_position(urls, x) = i) AS c FROM u) SELECT conv_id, array_to_string(c[1:3], ' ') AS candidates FROM k""")  # fmt: skip
def candidate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("ftp://x/"), "turn")).otherwise(F.concat(F.lit("https://h"), F.col("turn") % 4, F.lit("/")))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", url.alias("u")))).alias("a"))
    return rows.select("conv_id", F.array_join(R.candidate_urls(F.col("a.u"), 3), " ").alias("candidates"))


@query("read_budget", """WITH p AS (SELECT conv_id, turn, length(text) AS n, greatest(2000 - coalesce(sum(least(length(text), 600)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS remaining FROM conversations)
    SELECT conv_id, turn, remaining, least(n, 600, remaining) AS returned, least(n, 600, remaining) < n AS truncated FROM p""")  # fmt: skip
def read_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("ordinal"), F.length("text").cast("long").alias("length"))
    return R.read_budget(parts, 2000, 600).select(F.col("request_id").alias("conv_id"), F.col("ordinal").alias("turn"), "remaining", "returned", "truncated")


@query("compaction", """WITH r AS (SELECT conv_id, turn, length(text) AS size, role = 'system' OR turn = 0 AS protected FROM conversations),
    d AS (SELECT *, sum(size) OVER (PARTITION BY conv_id) - coalesce(sum(size) FILTER (NOT protected) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM r)
    SELECT conv_id, turn, protected OR rest <= 1500 AS kept FROM d""")  # fmt: skip
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("ref"), F.length("text").cast("long").alias("size"), ((F.col("role") == "system") | (F.col("turn") == 0)).alias("protected"))
    return R.compaction(rows, 1500).select(F.col("request_id").alias("conv_id"), F.col("ref").alias("turn"), "kept")


@query("audit_tally", f"WITH {_EV} SELECT event_type AS decision, count(*) AS calls, sum(bytes)::BIGINT AS bytes FROM ev GROUP BY 1")
def audit_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.audit_summary(_events(spark, sf_dir).withColumn("decision", F.col("event_type")), "decision")


@query("dangerous_addresses", """WITH x AS (SELECT event_id, event_id % 256 AS a, user_id * 16 % 256 AS b, (event_id % 256) || '.' || (user_id * 16 % 256) || '.2.1' AS ip FROM events), n AS (SELECT *, a * 16777216 + b * 65536 + 2 * 256 + 1 AS n FROM x)
    SELECT event_id, ip, a IN (0, 10, 127) OR a >= 224 OR n // 4194304 = (100 * 256 + 64) // 64 OR n // 65536 IN (169 * 256 + 254, 192 * 256 + 168) OR n // 1048576 = (172 * 256 + 16) // 16 OR n // 131072 = (198 * 256 + 18) // 2 OR n // 256 IN (192 * 65536, 192 * 65536 + 2) AS dangerous FROM n""")  # fmt: skip
def dangerous_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address classes come from a registry in Python; the reserved ranges as integers must agree with it."""
    ip = F.concat_ws(".", F.col("event_id") % 256, F.col("user_id") * 16 % 256, F.lit(2), F.lit(1))
    return read(spark, sf_dir, "events").select("event_id", ip.alias("ip"), R.dangerous_ip(ip).alias("dangerous"))
