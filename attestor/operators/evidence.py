"""The evidence ledger: freshness, applicability, authority, conflicts and claim states, assessed for many claims at once.

Evidence rows: claim_id, seq (order of arrival), ref, publisher, normalized_claim, source_authority and source_rationale (null: no approved
source), source_jurisdictions, freshness_days, jurisdiction, published_at, updated_at, effective_at, expires_at, pack_version, applies_to_version.
Clocks are arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor.operators.dealing import dealt

GLOBAL = "GLOBAL"


def freshness(today: Column, expires: Column, updated: Column, published: Column, days: Column) -> Column:
    """Expired, unknown (no date or no rule), stale or current, in that order."""
    reference = F.coalesce(updated, published)
    return F.when(expires.isNotNull() & (today > expires), "expired").when(reference.isNull() | days.isNull(), "unknown").when(F.datediff(today, reference) > days, "stale").otherwise("current")


def jurisdiction_applicable(jurisdictions: Column, requested: Column) -> Column:
    known = requested.isNotNull() & (requested != "unknown")
    return F.array_contains(jurisdictions, GLOBAL) | (known & F.coalesce(F.array_contains(jurisdictions, requested), F.lit(False)))


def applicable(e: DataFrame, jurisdiction: Column, as_of: Column, version: Column) -> Column:
    """Jurisdiction only where a source is known; dates only where one is asked about; versions only where both are given."""
    place = e.source_authority.isNull() | jurisdiction_applicable(e.source_jurisdictions, jurisdiction)
    time = as_of.isNull() | (F.coalesce(e.effective_at <= as_of, F.lit(True)) & F.coalesce(e.expires_at >= as_of, F.lit(True)))
    return place & time & F.coalesce(e.applies_to_version == version, F.lit(True))


def dates_in_order(published: Column, updated: Column, effective: Column, expires: Column) -> Column:
    return F.coalesce(updated >= published, F.lit(True)) & F.coalesce(expires >= effective, F.lit(True))


def authority(source_authority: Column) -> Column:
    """The approved source's; never what a record says of itself."""
    return F.coalesce(source_authority, F.lit("unknown"))


def conflicts(evidence: DataFrame) -> DataFrame:
    """Per claim with several normalized claims: the sorted classes of their pairwise conflicts, each group represented by its first row.

    No pairs are made: two groups conflict in a class iff those that agree in all that comes before it hold several values of it. A null is a value of its own.
    """
    head = F.struct("seq", "jurisdiction", "effective_at", "pack_version", "applies_to_version")
    groups = evidence.groupBy("claim_id", "normalized_claim").agg(F.min(head).alias("h")).select("claim_id", "h.*")
    alike = groups.groupBy("claim_id", "jurisdiction", "effective_at", "pack_version", "applies_to_version").agg(F.count("*").alias("wordings"))
    at = alike.groupBy("claim_id", "jurisdiction", "effective_at").agg(F.count("*").alias("versions"), F.max("wordings").alias("wordings"))
    place = at.groupBy("claim_id", "jurisdiction").agg(F.count("*").alias("times"), F.max("versions").alias("versions"), F.max("wordings").alias("wordings"))
    claim = place.groupBy("claim_id").agg(F.count("*").alias("places"), *(F.max(c).alias(c) for c in ("times", "versions", "wordings")))
    several = (("wordings", "definition"), ("places", "jurisdiction"), ("times", "time"), ("versions", "version"))  # in the classes' order
    classes = F.array_compact(F.array(*(F.when(F.col(c) > 1, name) for c, name in several)))
    return claim.select("claim_id", classes.alias("conflict_classes")).where("size(conflict_classes) > 0")


def assess(claims: DataFrame, evidence: DataFrame, today: Column, number: int | None = None) -> DataFrame:
    """Claims (claim_id, jurisdiction, as_of, requested_version) with state, corroboration, counts of references, conflict classes and uncertainty.

    ``number``: of evidence rows, if it is known; by it they are dealt to tasks.
    """
    asked = claims.select("claim_id", F.col("jurisdiction").alias("asked_jurisdiction"), "as_of", "requested_version")
    rows = dealt(evidence, number, "claim_id").join(asked, "claim_id")
    rows = rows.withColumn("applies", applicable(rows, rows.asked_jurisdiction, rows.as_of, rows.requested_version))
    rows = rows.withColumn("authority", authority(F.col("source_authority"))).withColumn("freshness", freshness(today, F.col("expires_at"), F.col("updated_at"), F.col("published_at"), F.when(F.col("source_authority").isNotNull(), F.col("freshness_days"))))
    current = F.col("applies") & (F.col("authority") != "unknown") & (F.col("freshness") == "current")
    first = Window.partitionBy("claim_id").orderBy(F.col("applies").desc(), "seq")
    rows = rows.withColumns({"first_claim": F.first("normalized_claim").over(first), "current": current})
    # what is distinct is counted by its first row: no shuffle but by claim, where a distinct count takes two more
    once = lambda column, flag: F.col(flag) & F.col(column).isNotNull() & (F.row_number().over(Window.partitionBy("claim_id", column).orderBy(F.desc(flag))) == 1)
    rows = rows.withColumns({"new_claim": once("normalized_claim", "applies"), "new_publisher": once("publisher", "current")})
    led = rows.groupBy("claim_id").agg(
        F.count("*").alias("evidence"), F.count_if("applies").alias("applicable"), F.count_if("new_claim").alias("groups"),
        F.count_if(F.col("applies") & (F.col("normalized_claim") == F.col("first_claim"))).alias("agreeing"),
        F.bool_or(F.col("applies") & (F.col("authority") != "unknown")).alias("any_authority"), F.count_if("new_publisher").alias("publishers"),
    )
    out = claims.join(led, "claim_id", "left").join(conflicts(rows.where("applies")), "claim_id", "left")
    none, nowhere = F.coalesce("evidence", F.lit(0)) == 0, F.coalesce("applicable", F.lit(0)) == 0
    state = F.when(none | nowhere, "insufficient").when(F.col("groups") > 1, "conflicted").when(~F.col("any_authority"), "unknown").when(F.col("publishers") == 0, "insufficient").otherwise("supported")
    missing = F.array_compact(F.array(F.when(F.col("jurisdiction").isNull(), "missing_jurisdiction"), F.when(F.col("as_of").isNull(), "missing_effective_date")))
    reasons = (
        F.when(none, F.array(F.lit("no_evidence"))).when(nowhere, F.when(F.size(missing) > 0, missing).otherwise(F.array(F.lit("no_applicable_evidence"))))
        .when(F.col("groups") > 1, F.array(F.lit("evidence_disagrees"))).when(~F.col("any_authority"), F.array(F.lit("authority_unknown")))
        .when(F.col("publishers") == 0, F.array(F.lit("no_current_authoritative_evidence"))).otherwise(F.array().cast("array<string>"))
    )
    return out.select(
        "claim_id", state.alias("state"), F.when(state == "supported", F.col("publishers")).otherwise(0).alias("corroboration"),
        F.when(state == "conflicted", F.col("agreeing")).otherwise(F.coalesce("applicable", F.lit(0))).alias("supporting"),
        F.when(state == "conflicted", F.col("applicable") - F.col("agreeing")).otherwise(0).alias("conflicting"),
        (F.coalesce("evidence", F.lit(0)) - F.coalesce("applicable", F.lit(0))).alias("non_applicable"),
        F.when(state == "conflicted", F.col("conflict_classes")).otherwise(F.array().cast("array<string>")).alias("conflict_classes"), reasons.alias("uncertainty"),
    )


def verify_extract(extract: Column, digest: Column, most: int = 200_000) -> Column:
    """Whether an extract is within its size and, if a digest is stated, is what the digest says."""
    return (F.length(extract) <= most) & F.coalesce(F.concat(F.lit("sha256:"), F.sha2(extract, 256)) == digest, F.lit(True))
