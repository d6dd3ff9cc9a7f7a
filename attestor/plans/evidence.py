"""The ledger over TPC-H-like tables: a claim per order, its lines the evidence, suppliers the publishers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor.operators import evidence as E
from attestor.operators.dealing import dealt
from attestor.plans.catalog import query, read

TODAY = "1998-06-01"


def _number(spark: SparkSession, sf_dir: str) -> int:
    """Of evidence rows, told by the files' footers."""
    return read(spark, sf_dir, "lineitem").count()


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = dealt(read(spark, sf_dir, "lineitem"), _number(spark, sf_dir), "l_suppkey")
    places = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = line.join(places.select("s_suppkey", "s_name", "r_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    ship, known = F.to_date("l_shipdate"), F.col("l_suppkey") % 4 != 0
    return rows.select(
        F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).cast("long").alias("seq"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ref"), F.col("s_name").alias("publisher"),
        F.when(F.col("l_orderkey") % 3 == 0, F.col("l_returnflag")).otherwise("same").alias("normalized_claim"), F.when(known, "official").alias("source_authority"), F.when(known, F.lit("by its office")).alias("source_rationale"),
        F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("GLOBAL"))).otherwise(F.array("r_name")).alias("source_jurisdictions"), F.when(known, F.lit(1200)).alias("freshness_days"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("r_name")).alias("jurisdiction"), ship.alias("published_at"), F.when(F.col("l_linenumber") % 2 == 0, F.date_add(ship, 30)).alias("updated_at"),
        F.when(F.col("l_orderkey") % 5 == 0, F.date_add(ship, -100)).alias("effective_at"), F.when(F.col("l_linenumber") % 3 == 0, F.date_add(ship, 1500)).alias("expires_at"),
        F.lit(None).cast("string").alias("pack_version"), F.when(F.col("l_orderkey") % 7 == 0, F.col("l_linestatus")).alias("applies_to_version"),
    )


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    names = F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE")))
    return o.select(
        F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 6 != 0, F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int"))).alias("jurisdiction"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_add(F.to_date("o_orderdate"), 400)).alias("as_of"), F.when(F.col("o_orderkey") % 14 == 0, "O").alias("requested_version"),
    )


_E = f"""
    ev AS (SELECT l_orderkey AS claim_id, l_linenumber::BIGINT * 1000000 + l_partkey AS seq, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ref, s_name AS publisher, CASE WHEN l_orderkey % 3 = 0 THEN l_returnflag ELSE 'same' END AS nc, l_suppkey % 4 <> 0 AS known,
        CASE WHEN l_suppkey % 3 = 0 THEN 'GLOBAL' ELSE r_name END AS sj, CASE WHEN l_orderkey % 2 = 0 THEN r_name END AS jur, l_shipdate::DATE AS pub, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE + 30 END AS upd,
        CASE WHEN l_orderkey % 5 = 0 THEN l_shipdate::DATE - 100 END AS eff, CASE WHEN l_linenumber % 3 = 0 THEN l_shipdate::DATE + 1500 END AS exp, CASE WHEN l_orderkey % 7 = 0 THEN l_linestatus END AS ver
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    fr AS (SELECT *, CASE WHEN exp IS NOT NULL AND DATE '{TODAY}' > exp THEN 'expired' WHEN NOT known THEN 'unknown' WHEN date_diff('day', coalesce(upd, pub), DATE '{TODAY}') > 1200 THEN 'stale' ELSE 'current' END AS freshness FROM ev)"""
_C = """
    cl AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderkey % 6 <> 0 THEN ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE'][o_custkey % 4 + 1] END AS aj, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate::DATE + 400 END AS as_of, CASE WHEN o_orderkey % 14 = 0 THEN 'O' END AS rv FROM orders),
    ap AS (SELECT fr.*, (NOT known OR sj = 'GLOBAL' OR coalesce(sj = aj, false)) AND (as_of IS NULL OR (coalesce(eff <= as_of, true) AND coalesce(exp >= as_of, true))) AND coalesce(ver = rv, true) AS applies FROM fr JOIN cl USING (claim_id)),
    hd AS (SELECT claim_id, nc, min({'seq': seq, 'jur': jur, 'eff': eff, 'ver': ver}) AS h FROM ap WHERE applies GROUP BY ALL),
    cf AS (SELECT a.claim_id, CASE WHEN a.h.jur IS DISTINCT FROM b.h.jur THEN 'jurisdiction' WHEN a.h.eff IS DISTINCT FROM b.h.eff THEN 'time' WHEN a.h.ver IS DISTINCT FROM b.h.ver THEN 'version' ELSE 'definition' END AS c FROM hd a JOIN hd b ON a.claim_id = b.claim_id AND a.h.seq < b.h.seq),
    cc AS (SELECT claim_id, string_agg(DISTINCT c, ',' ORDER BY c) AS classes FROM cf GROUP BY claim_id),
    fc AS (SELECT claim_id, arg_min(nc, seq) AS nc1 FROM ap WHERE applies GROUP BY claim_id),
    ld AS (SELECT claim_id, count(*) AS n, count(*) FILTER (applies) AS a, count(DISTINCT nc) FILTER (applies) AS g, count(*) FILTER (applies AND nc = nc1) AS agree, coalesce(bool_or(applies AND known), false) AS auth, count(DISTINCT publisher) FILTER (applies AND known AND freshness = 'current') AS pubs FROM ap LEFT JOIN fc USING (claim_id) GROUP BY claim_id)"""


@query("evidence_freshness", f"WITH {_E} SELECT ref, freshness, CASE WHEN known THEN 'official' ELSE 'unknown' END AS authority, coalesce(upd >= pub, true) AND coalesce(exp >= eff, true) AS in_order FROM fr")
def evidence_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    return e.select("ref", E.freshness(F.lit(TODAY).cast("date"), e.expires_at, e.updated_at, e.published_at, e.freshness_days).alias("freshness"), E.authority(e.source_authority).alias("authority"), E.dates_in_order(e.published_at, e.updated_at, e.effective_at, e.expires_at).alias("in_order"))


@query("claim_ledger", f"""WITH {_E}, {_C}, st AS (SELECT cl.claim_id, aj, as_of, n, a, g, agree, auth, pubs, classes, CASE WHEN coalesce(a, 0) = 0 THEN 'insufficient' WHEN g > 1 THEN 'conflicted' WHEN NOT auth THEN 'unknown' WHEN pubs = 0 THEN 'insufficient' ELSE 'supported' END AS state FROM cl LEFT JOIN ld USING (claim_id) LEFT JOIN cc USING (claim_id))
    SELECT claim_id, state, CASE WHEN state = 'supported' THEN pubs ELSE 0 END AS corroboration, CASE WHEN state = 'conflicted' THEN agree ELSE coalesce(a, 0) END AS supporting, CASE WHEN state = 'conflicted' THEN a - agree ELSE 0 END AS conflicting, coalesce(n, 0) - coalesce(a, 0) AS non_applicable,
        CASE WHEN state = 'conflicted' THEN classes ELSE '' END AS conflict_classes,
        CASE WHEN coalesce(n, 0) = 0 THEN 'no_evidence' WHEN a = 0 THEN CASE WHEN aj IS NULL AND as_of IS NULL THEN 'missing_jurisdiction,missing_effective_date' WHEN aj IS NULL THEN 'missing_jurisdiction' WHEN as_of IS NULL THEN 'missing_effective_date' ELSE 'no_applicable_evidence' END
             WHEN g > 1 THEN 'evidence_disagrees' WHEN NOT auth THEN 'authority_unknown' WHEN pubs = 0 THEN 'no_current_authoritative_evidence' ELSE '' END AS uncertainty FROM st""")  # fmt: skip
def claim_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.assess(_claims(spark, sf_dir), _evidence(spark, sf_dir), F.lit(TODAY).cast("date"), _number(spark, sf_dir))
    return out.withColumn("conflict_classes", F.array_join("conflict_classes", ",")).withColumn("uncertainty", F.array_join("uncertainty", ","))


@query("claim_conflicts", f"WITH {_E}, {_C} SELECT claim_id, classes AS conflict_classes FROM cc")
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = _evidence(spark, sf_dir), _claims(spark, sf_dir).select("claim_id", F.col("jurisdiction").alias("aj"), "as_of", "requested_version")
    rows = dealt(e, _number(spark, sf_dir), "claim_id").join(c, "claim_id")
    rows = rows.where(E.applicable(rows, rows.aj, rows.as_of, rows.requested_version))
    return E.conflicts(rows).withColumn("conflict_classes", F.array_join("conflict_classes", ","))


@query("claim_groups", f"WITH {_E} SELECT claim_id, nc AS normalized_claim, min(seq) AS first_seq, count(*) AS refs FROM ev GROUP BY ALL")
def claim_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a claim by wording, in the order in which wordings were first seen."""
    return _evidence(spark, sf_dir).groupBy("claim_id", "normalized_claim").agg(F.min("seq").alias("first_seq"), F.count("*").alias("refs"))


@query("extract_verification", """SELECT doc_id, length(text) <= 200000 AND coalesce('sha256:' || sha256(text) = CASE doc_id % 3 WHEN 0 THEN 'sha256:' || sha256(text) WHEN 1 THEN 'sha256:0' END, true) AS verified FROM documents""")
def extract_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("sha256:"), F.sha2("text", 256))).when(F.col("doc_id") % 3 == 1, "sha256:0")
    return read(spark, sf_dir, "documents").select("doc_id", E.verify_extract(F.col("text"), stated).alias("verified"))
