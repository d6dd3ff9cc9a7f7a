"""Context assembly over stand-in tables: customers are requests, orders claims, events live research."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor.operators import context as C
from attestor.plans.catalog import query, read

_CLAIMS = """a AS (SELECT o_custkey AS request_id, o_orderkey AS seq, 'c' || o_orderkey AS text, CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'conflicted' ELSE 'unknown' END AS state, ['e' || (o_orderkey % 50)] AS sup,
        CASE WHEN o_orderstatus = 'O' THEN ['e' || (o_orderkey % 50 + 1)] ELSE [] END AS con, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'numeric, temporal' ELSE 'unspecified' END AS classes,
        CASE WHEN o_orderstatus = 'P' THEN ['authority_unknown', 'needs_' || (o_orderkey % 3)] ELSE [] END AS uncertainty FROM orders)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, status, none = F.col("o_orderkey"), F.col("o_orderstatus"), F.array().cast("array<string>")
    listed = lambda cond, *xs: F.when(cond, F.array(*xs)).otherwise(none)
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("request_id"), k.alias("seq"), F.concat(F.lit("c"), k).alias("claim_text"), F.when(status == "F", "supported").when(status == "O", "conflicted").otherwise("unknown").alias("state"),
        F.array(F.concat(F.lit("e"), k % 50)).alias("supporting_refs"), listed(status == "O", F.concat(F.lit("e"), k % 50 + 1)).alias("conflicting_refs"), none.alias("other_refs"),
        listed((status == "O") & (k % 2 == 0), F.lit("numeric"), F.lit("temporal")).alias("conflict_classes"), listed(status == "P", F.lit("authority_unknown"), F.concat(F.lit("needs_"), k % 3)).alias("uncertainty"),
    )


def _text(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


@query("context_assembly", f"""WITH {_CLAIMS}, q AS (SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'route_only' WHEN 1 THEN 'abstained' ELSE 'proceed' END AS outcome, c_custkey % 10 = 0 AS action FROM customer),
    ap AS (SELECT a.* FROM a JOIN q USING (request_id) WHERE outcome = 'proceed'),
    ci AS (SELECT request_id, seq, unnest(list_concat(sup, con)) AS ref, generate_subscripts(list_concat(sup, con), 1) AS i FROM ap),
    bad AS (SELECT DISTINCT request_id FROM ci WHERE ref = 'e13' AND request_id % 4 = 0),
    rs AS (SELECT user_id AS request_id, event_id AS seq, event_type IN ('click', 'purchase') AS good, 'live-' || (event_id % 6) AS ref, event_type AS code FROM events JOIN q ON request_id = user_id WHERE outcome = 'proceed'),
    ev AS (SELECT request_id, 0 AS late, seq, i, ref FROM ci UNION ALL SELECT request_id, 1, seq, 0, ref FROM rs WHERE good),
    e1 AS (SELECT request_id, ref, min({{'late': late, 'seq': seq, 'i': i}}) AS o FROM ev GROUP BY ALL), e2 AS (SELECT request_id, string_agg(ref, '|' ORDER BY o) AS evidence FROM e1 GROUP BY 1),
    dg AS (SELECT request_id, string_agg('research_unavailable:' || code, '|' ORDER BY seq) AS degradation FROM rs WHERE NOT good GROUP BY 1),
    gp AS (SELECT request_id, seq, unnest(uncertainty) AS gap, generate_subscripts(uncertainty, 1) AS i FROM ap), g1 AS (SELECT request_id, gap, min({{'seq': seq, 'i': i}}) AS o FROM gp GROUP BY ALL), g2 AS (SELECT request_id, string_agg(gap, '|' ORDER BY o) AS gaps FROM g1 GROUP BY 1),
    cl AS (SELECT request_id, count(*) AS claims, bool_and(state = 'supported') AS supported, string_agg(CASE WHEN state = 'conflicted' THEN 'Claim ''' || text || ''' has conflicting evidence (' || classes || ').' END, '|' ORDER BY seq) AS conflicts FROM ap GROUP BY 1),
    al AS (SELECT q.*, evidence, degradation, CASE WHEN evidence IS NULL AND claims IS NULL THEN 'no_evidence_available' ELSE gaps END AS gaps, claims, supported, conflicts, bad.request_id IS NOT NULL AS failed
           FROM q LEFT JOIN e2 USING (request_id) LEFT JOIN dg USING (request_id) LEFT JOIN g2 USING (request_id) LEFT JOIN cl USING (request_id) LEFT JOIN bad ON bad.request_id = q.request_id)
    SELECT request_id, CASE WHEN outcome <> 'proceed' THEN outcome WHEN failed THEN 'abstained' WHEN coalesce(supported, false) AND evidence IS NOT NULL AND gaps IS NULL AND degradation IS NULL THEN 'complete' ELSE 'partial' END AS status,
        CASE WHEN outcome <> 'proceed' OR failed THEN '' ELSE coalesce(evidence, '') END AS evidence, CASE WHEN outcome <> 'proceed' OR failed THEN '' ELSE coalesce(conflicts, '') END AS conflicts,
        CASE WHEN outcome <> 'proceed' THEN 'routed' WHEN failed THEN 'assembly_failed' ELSE coalesce(gaps, '') END AS gaps,
        CASE WHEN outcome <> 'proceed' THEN CASE WHEN action THEN 'consequential_action_refused_no_action_performed' ELSE '' END WHEN failed THEN 'evidence_ref_not_in_pool' WHEN gaps LIKE '%authority_unknown%' THEN 'unverified_authority_evidence_present' ELSE '' END AS warnings,
        CASE WHEN outcome <> 'proceed' OR failed THEN '' ELSE coalesce(degradation, '') END AS degradation, CASE WHEN outcome <> 'proceed' OR failed THEN 0 ELSE coalesce(claims, 0) END AS claims FROM al""")  # fmt: skip
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from claims, the evidence pool and live research; only requests that may proceed get any."""
    k = F.col("c_custkey")
    requests = read(spark, sf_dir, "customer").select(
        k.alias("request_id"), F.when(k % 5 == 0, "route_only").when(k % 5 == 1, "abstained").otherwise("proceed").alias("outcome"), F.when(k % 10 == 0, C.CONSEQUENTIAL).alias("reason"), F.array(F.lit("routed")).alias("route_gaps"),
    )
    refs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.concat(F.lit("e"), i)))
    pool = requests.select("request_id", refs.alias("ref")).where("NOT (ref = 'e13' AND request_id % 4 = 0)")
    good = F.col("event_type").isin("click", "purchase")
    research = read(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), F.when(good, "fetched").otherwise("error").alias("status"), F.col("event_type").alias("code"), F.concat(F.lit("live-"), F.col("event_id") % 6).alias("ref"))
    out = C.assemble(requests, _claims(spark, sf_dir), pool, research)
    return out.select("request_id", "status", _text("evidence"), _text("conflicts"), _text("gaps"), _text("warnings"), _text("degradation"), "claims")


@query("protected_refs", f"WITH {_CLAIMS} SELECT DISTINCT request_id, unnest(list_concat(sup, con)) AS ref FROM a")
def protected_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that compaction keeps, from the records of claims."""
    return C.protected_refs(C.claim_records(_claims(spark, sf_dir)))
