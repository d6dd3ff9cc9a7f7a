"""Live evidence: admission, cache with time to live, a pooled budget, reads under budget, compaction, audit. Clocks are arguments.

Requests of an investigation are windows partitioned by it, so no window is global.
"""

from __future__ import annotations

import ipaddress
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

# Floors of the pooled budget.
FLOOR_REQUESTS, FLOOR_BYTES, FLOOR_MS = 1, 1024, 1
BLOCKED = ("host_not_allowlisted", "access_restricted", "dangerous_ip_blocked", "unsupported_scheme", "invalid_url")


@pandas_udf(BooleanType())
def dangerous_ip(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whether an address is anything but a public unicast one; text that is no address is dangerous."""
    def bad(raw: str | None) -> bool:
        try:
            a = ipaddress.ip_address(raw or "")
        except ValueError:
            return True
        return not a.is_global or a.is_multicast or a.is_reserved or a.is_loopback or a.is_private or a.is_link_local or a.is_unspecified

    for s in parts:
        yield s.map(bad)


def bounded_body(limit: int):
    """A function of a captured body and its content encoding: (code, body), the body inflated; neither it nor what was sent may exceed ``limit`` bytes.

    Inflating stops one byte past the limit, so a small body can't take much memory.
    """

    def inflate(raw: bytes | None, encoding: str | None) -> tuple[str, bytes | None]:
        raw, encoding = bytes(raw or b""), (encoding or "").strip().lower()
        if encoding not in ("", "identity", "gzip", "deflate"):
            return "unsupported_content_encoding", None
        if len(raw) > limit:
            return "raw_bytes_limit_exceeded", None
        if encoding in ("", "identity"):
            return "ok", raw
        reader = zlib.decompressobj(16 + zlib.MAX_WBITS if encoding == "gzip" else zlib.MAX_WBITS)
        try:
            out = reader.decompress(raw, limit + 1)
        except zlib.error:
            return "read_failed", None
        if len(out) > limit or reader.unconsumed_tail or not reader.eof:
            return "decompressed_limit_exceeded", None
        return "ok", out

    @pandas_udf("code string, body binary")
    def apply(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raw, encoding in parts:
            yield pd.DataFrame([inflate(r, e) for r, e in zip(raw, encoding, strict=True)], columns=["code", "body"])

    return apply


def status_for(code: Column) -> Column:
    return F.when(code == "network_disabled", "disabled").when(code.isin(*BLOCKED), "blocked").otherwise("error")


def candidate_urls(urls: Column, most: int) -> Column:
    """http(s) URLs in order, each once, the first ``most``."""
    return F.slice(F.array_distinct(F.filter(urls, lambda u: u.rlike("^https?://"))), 1, most)


def admitted(host: Column, port: Column, allowed: Column) -> Column:
    return F.array_contains(allowed, host) | F.array_contains(allowed, F.concat_ws(":", host, port.cast("string")))


def path_denied(requests: DataFrame, denied: DataFrame) -> Column:
    """Condition for a semi-join: a denied prefix (host, prefix) of the request's host begins its path."""
    return (requests.host == denied.host) & requests.path.startswith(denied.prefix)


def cache_state(entries: DataFrame, now: Column, ttl_seconds: int) -> Column:
    """Hit, expired, or implausible: an entry that would outlive the time to live from now was never written under it."""
    left = F.unix_timestamp(entries.expires_at) - F.unix_timestamp(now)
    return F.when(left < 0, "expired").when(left > ttl_seconds, "implausible").otherwise("hit")


def latest(entries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last write of each key."""
    return entries.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def ledger(calls: DataFrame, requests: int, most_bytes: int) -> DataFrame:
    """Calls (investigation, seq, bytes, cached) with what was left before each and whether it was funded.

    Cache hits are neither charged nor denied. Charges only grow, so once a floor fails it stays failed, and a sum over earlier live
    calls decides exactly as a running balance would.
    """
    before = Window.partitionBy("investigation").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    live = F.when(F.col("cached"), 0).otherwise(1)
    spent_requests = F.coalesce(F.sum(live).over(before), F.lit(0))
    spent_bytes = F.coalesce(F.sum(live * F.col("bytes")).over(before), F.lit(0))
    rows = calls.withColumn("requests_left", F.greatest(F.lit(requests) - spent_requests, F.lit(0))).withColumn("bytes_left", F.greatest(F.lit(most_bytes) - spent_bytes, F.lit(0)))
    denied = ~F.col("cached") & ((F.col("requests_left") < FLOOR_REQUESTS) | (F.col("bytes_left") < FLOOR_BYTES))
    return rows.withColumn("decision", F.when(F.col("cached"), "cached").when(denied, "network_budget_exhausted").otherwise("fetch"))


def _running(rows: DataFrame, names: list[str], block: bool) -> DataFrame:
    """Adds, for each name, the sum over an investigation's earlier calls as ``before_<name>``.

    With a block, calls are sorted within (investigation, block) only, and blocks get what came before them from their sums: no investigation
    has to fit one task.
    """
    parts = ["investigation", "__block"] if block else ["investigation"]
    before = Window.partitionBy(*parts).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in names})
    if not block:
        return rows
    sums = rows.groupBy("investigation", "__block").agg(*(F.sum(n).alias(f"sum_{n}") for n in names))
    earlier = Window.partitionBy("investigation").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("investigation").alias("__of"), F.col("__block").alias("__part"), *(F.coalesce(F.sum(f"sum_{n}").over(earlier), F.lit(0)).alias(f"sum_{n}") for n in names))
    rows = rows.join(sums, rows.investigation.eqNullSafe(F.col("__of")) & rows["__block"].eqNullSafe(F.col("__part"))).drop("__of", "__part")
    return rows.withColumns({f"before_{n}": F.col(f"before_{n}") + F.col(f"sum_{n}") for n in names}).drop(*(f"sum_{n}" for n in names))


def timed_ledger(calls: DataFrame, requests: int, most_bytes: int, most_ms: int, block: Column | None = None) -> DataFrame:
    """``ledger`` in three dimensions: calls (investigation, seq, bytes, elapsed_ms, cached) with what was left before each, time included.

    A live call may take no longer than what is left of the investigation's time, and is cut off then (timed_out); one that isn't funded takes
    nothing. A cached answer takes its time, no request and no bytes, and is never denied. Adds requests_left, bytes_left, ms_left, ms_charged, decision, timed_out, and
    exhausted: the first of requests, bytes and time that is under its floor where a call is denied.

    Once a floor fails it stays failed, so sums over all earlier calls decide; what is left is then counted over funded and cached ones. ``block``
    names a coarse part of the order that never falls as seq rises (the day of a call, say): an investigation's calls are then summed block by block.
    Null bytes and times count as none, a null cached as a live call; calls without an investigation share one pool.
    """
    nothing = F.lit(0).cast("long")
    live = ~F.coalesce("cached", F.lit(False))
    rows = calls.withColumns({"__live": live, "__ms": F.coalesce("elapsed_ms", nothing).cast("long"), "__block": F.lit(0) if block is None else block})
    rows = rows.withColumns({"__r": live.cast("long"), "__b": F.when(live, F.coalesce("bytes", nothing)).otherwise(nothing)})
    split = block is not None

    def left(names: tuple[str, str, str]) -> dict[str, Column]:
        return {c: F.greatest(F.lit(most) - F.col(f"before_{n}"), F.lit(0)).cast("long") for c, n, most in zip(("requests_left", "bytes_left", "ms_left"), names, (requests, most_bytes, most_ms), strict=True)}

    short = F.when(F.col("requests_left") < FLOOR_REQUESTS, "requests").when(F.col("bytes_left") < FLOOR_BYTES, "bytes").when(F.col("ms_left") < FLOOR_MS, "time")
    rows = _running(rows, ["__r", "__b", "__ms"], split).withColumns(left(("__r", "__b", "__ms"))).withColumn("__denied", F.col("__live") & short.isNotNull())
    rows = rows.drop("before___r", "before___b", "before___ms")
    spent = {f"__f{n}": F.when(F.col("__denied"), nothing).otherwise(F.col(f"__{n}")) for n in ("r", "b", "ms")}
    rows = _running(rows.withColumns(spent), list(spent), split).withColumns(left(tuple(spent))).withColumn("exhausted", F.when(F.col("__denied"), short))
    funded = F.col("__live") & F.col("exhausted").isNull()
    rows = rows.withColumns({
        "ms_charged": F.when(F.col("exhausted").isNotNull(), nothing).otherwise(F.least("__ms", "ms_left")), "timed_out": funded & (F.col("__ms") > F.col("ms_left")),
        "decision": F.when(~F.col("__live"), "cached").when(funded, "fetch").otherwise("network_budget_exhausted"),
    })
    return rows.drop("__live", "__denied", "__ms", "__block", "__r", "__b", *spent, *(f"before_{n}" for n in spent))


def decide(requests: DataFrame) -> Column:
    """The ladder in order: switched off, no URL, no budget, not allowed, denied path, cached under today's policy, fetch."""
    r = requests
    return (
        F.when(~r.enabled | (r.policy != "public_https"), "network_disabled").when(r.url.isNull(), "no_candidate_url").when(r.budget < 1, "network_budget_exhausted")
        .when(~r.allowed, "host_not_allowlisted").when(r.denied, "access_restricted").when((r["cache"] == "hit") & (r.cached_policy == r.policy_version), "cached").otherwise("fetch")
    )


def read_budget(parts: DataFrame, most: int, item: int) -> DataFrame:
    """Requested texts (request_id, ordinal, length) in order under a total: what each gets."""
    before = Window.partitionBy("request_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(most) - F.coalesce(F.sum(F.least(F.col("length"), F.lit(item))).over(before), F.lit(0)), F.lit(0))
    got = F.least(F.col("length"), F.lit(item), left)
    return parts.withColumn("remaining", left).withColumn("returned", got).withColumn("truncated", got < F.col("length"))


def compaction(records: DataFrame, budget: int) -> DataFrame:
    """Records (request_id, ref, size, protected) that stay when unprotected ones are dropped in descending order of reference until the total fits."""
    total = F.sum("size").over(Window.partitionBy("request_id"))
    after = F.coalesce(F.sum(F.when(~F.col("protected"), F.col("size"))).over(Window.partitionBy("request_id").orderBy(F.desc("ref")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return records.withColumn("kept", F.col("protected") | (total - after <= budget))


def audit_summary(audit: DataFrame, by: str) -> DataFrame:
    return audit.groupBy(by).agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"))
