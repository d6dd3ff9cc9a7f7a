"""Reading references back from four stores: skills, capabilities, captured pages and local passages, with cursors that resume a call.

A reference's prefix says which store answers it; no other store can. Lengths decide first what every request gets, so that of the texts only
the slices that are returned leave their rows. A request has at most ``most_refs`` references; those with more are refused before anything is
grouped by request, so no group in a window is larger than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor import scratch

#: What a reference to anything but a local passage begins with.
PREFIXED = ("skill", "capability", "live")
MAX_REFS = 10
#: No ceiling over a chain of calls.
UNBOUNDED = 1 << 62

_CURSOR = "at array<struct<ordinal: long, start: long>>, left long, request string"
_STORE = ("kind", "ref", "text", "digest", "locator", "citation", "written_at", "expired")


def kind_of(ref: Column) -> Column:
    kind = F.when(ref.isNull(), None)
    for prefix in PREFIXED:
        kind = kind.when(ref.startswith(prefix + ":"), prefix)
    return kind.otherwise("local")


def _declared(rows: DataFrame, kind: str, ref: Column, citation: Column) -> DataFrame:
    """What a pack declares, as JSON of all its columns in alphabetical order: never a body, as there is no column for one."""
    json = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), ref).alias("ref"), json.alias("text"), "digest", "locator", citation.alias("citation"), F.lit(None).cast("timestamp").alias("written_at"), F.lit(False).alias("expired"))


def stores(local: DataFrame, skills: DataFrame | None = None, capabilities: DataFrame | None = None, live: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """One table of all that can be read: kind, ref, text, digest, locator, citation, written_at, expired.

    ``local``: ref, text, locator, citation, digest. ``skills`` (skill_id, version) and ``capabilities`` (capability_id, version), each with
    digest and locator, disclose all their columns; a skill's reference names its version, a capability's doesn't. ``live``: ref, excerpt, locator,
    citation, digest, written_at, expires_at; the excerpt is what was kept of the page, and it is expired after expires_at (null: never).
    Rows whose kind isn't that of their reference answer nothing, nor do those without one.
    """
    parts = [local.select(F.lit("local").alias("kind"), "ref", "text", "digest", "locator", "citation", F.lit(None).cast("timestamp").alias("written_at"), F.lit(False).alias("expired"))]
    if skills is not None:
        name = F.concat("skill_id", F.lit("@"), "version")
        parts.append(_declared(skills, "skill", name, name))
    if capabilities is not None:
        parts.append(_declared(capabilities, "capability", F.col("capability_id"), F.concat("capability_id", F.lit("@"), "version")))
    if live is not None:
        clock = F.current_timestamp() if now is None else now
        gone = F.coalesce(F.col("expires_at") < clock, F.lit(False))
        parts.append(live.select(F.lit("live").alias("kind"), "ref", F.col("excerpt").alias("text"), "digest", "locator", "citation", F.col("written_at").cast("timestamp").alias("written_at"), gone.alias("expired")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where(F.col("kind") == kind_of(F.col("ref"))).select(*_STORE)


def _checked(wanted: DataFrame, most_refs: int) -> DataFrame:
    """Wanted references with their request's fingerprint (null: the request is refused), counted before any of them meet in one task."""
    asked = wanted.select("request_id", F.col("ordinal").cast("long").alias("ordinal"), "ref", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    line = F.concat_ws("|", "ordinal", F.coalesce("ref", F.lit("")), F.coalesce(F.col("start").cast("string"), F.lit("")), F.coalesce(F.col("end").cast("string"), F.lit("")))
    part = F.conv(F.substring(F.sha2(line, 256), 1, 8), 16, 10).cast("long")
    shape = asked.groupBy("request_id").agg(F.count("*").alias("__n"), F.countDistinct("ordinal").alias("__d"), F.sum(part).cast("string").alias("request"))
    shape = shape.where((F.col("__n") <= most_refs) & (F.col("__d") == F.col("__n"))).select("request_id", "request")
    return asked.join(shape, "request_id", "left")


def _measured(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Adds kind, status (null: can be read), the length of what a reference stands for, and when it was written; a row each, no texts."""
    sizes = store.select("kind", "ref", F.length("text").cast("long").alias("n"), "written_at", "expired")
    found = rows.withColumn("kind", kind_of(F.col("ref"))).join(sizes, ["kind", "ref"], "left")
    newest = Window.partitionBy("request_id", "ordinal").orderBy(F.desc_nulls_last("written_at"))
    found = found.withColumn("__r", F.rank().over(newest)).withColumn("__k", F.row_number().over(newest)).where("__r = 1")
    ties = Window.partitionBy("request_id", "ordinal")
    found = found.withColumn("__ties", F.count("*").over(ties)).where("__k = 1")
    status = F.when(F.col("n").isNull(), "missing_ref").when(F.col("__ties") > 1, "ambiguous_ref").when(F.col("expired"), "expired_ref")
    return found.withColumn("status", status).drop("__r", "__k", "__ties", "expired")


def _windowed(rows: DataFrame, first: Column) -> DataFrame:
    """Adds first and size of the window that is wanted; a range that begins or ends outside of the text is none."""
    last = F.least(F.coalesce("end", "n"), F.col("n"))
    rows = rows.withColumn("first", first).withColumn("__last", last)
    outside = (F.col("first") < 1) | (F.col("first") > F.col("n")) | (F.col("__last") < F.col("first"))
    rows = rows.withColumn("status", F.coalesce("status", F.when(outside, "invalid_range"), F.lit("ok")))
    return rows.withColumn("size", F.when(F.col("status") == "ok", F.col("__last") - F.col("first") + 1).otherwise(F.lit(0).cast("long"))).drop("__last")


def _texts(plan: DataFrame, store: DataFrame) -> DataFrame:
    """The plan's rows with text, digest, locator and citation of what they name (nulls where nothing is to be read)."""
    held = store.select("kind", "ref", F.col("written_at").alias("__at"), "text", "digest", "locator", "citation")
    good = F.col("status") == "ok"
    got = plan.where(good).join(held, (plan.kind == held.kind) & (plan.ref == held.ref) & plan.written_at.eqNullSafe(F.col("__at"))).drop(held.kind).drop(held.ref).drop("__at")
    bad = plan.where(~good)
    return got.unionByName(bad, allowMissingColumns=True)


def read(
    wanted: DataFrame, store: DataFrame, *, most: int, item: int, total: int = UNBOUNDED, cursors: DataFrame | None = None, most_refs: int = MAX_REFS,
) -> tuple[DataFrame, DataFrame]:
    """One call for many requests: items, and per request where it stands.

    ``wanted``: request_id, ordinal, ref, start, end (code points from 1; nulls: the whole text). In the order of ordinals each reference gets at
    most ``item`` code points, all of a request's at most ``most``, and a chain of calls at most ``total``. Items: request_id, ordinal, ref, kind, status, text, first, last, truncated, digest,
    locator, citation. Status is ok, missing_ref, ambiguous_ref (the store holds it more than once and no row is the newest), expired_ref, invalid_range (also any range of an empty text), invalid_request
    (more than ``most_refs`` references, an ordinal that is null or repeats, no request_id) or invalid_cursor; only ok carries text, and only ok costs anything.
    The second table: request_id, cursor (null: nothing is left, or nothing may be read any more), returned, warning (output_budget_exhausted).

    ``cursors`` (request_id, cursor), as an earlier call gave them, resume: only requests with one are read, only what their call cut short, from
    where it was cut. A cursor carries the cut references' ordinals, their next code points, what is left of ``total``, and its request's fingerprint;
    one that can't be decoded or isn't of this very request is invalid_cursor. Where a request brings several, the smallest counts.
    """
    rows = _checked(wanted, most_refs)
    if cursors is None:
        rows = rows.withColumn("left", F.lit(total).cast("long")).withColumn("resume", F.lit(None).cast("long")).withColumn("__bad", F.lit(False))
    else:
        token = cursors.where("cursor IS NOT NULL").groupBy("request_id").agg(F.min("cursor").alias("__c"))
        plain = F.try_to_binary(F.translate("__c", "-_", "+/"), F.lit("base64")).cast("string")
        state = token.select("request_id", F.from_json(plain, _CURSOR).alias("__s"))
        rows = rows.join(state, "request_id")
        mine = F.get(F.filter("__s.at", lambda a: a.ordinal == F.col("ordinal")), F.lit(0)).start
        same = F.coalesce(F.col("__s.request") == F.col("request"), F.lit(False)) & F.coalesce((F.col("__s.left") > 0) & (F.size("__s.at") > 0), F.lit(False))
        rows = rows.withColumn("resume", mine).withColumn("left", F.col("__s.left")).withColumn("__bad", ~same)
    refused = F.when(F.col("request").isNull() | F.col("request_id").isNull(), "invalid_request").when(F.col("__bad"), "invalid_cursor")
    rows = rows.withColumn("__refused", refused)
    good = rows.where("__refused IS NULL")
    if cursors is not None:
        good = good.where("resume IS NOT NULL")
    keep = ["request_id", "ordinal", "ref", "kind", "status", "first", "size", "got", "left", "request", "written_at"]
    plan = _windowed(_measured(good, store), F.coalesce("resume", "start", F.lit(1).cast("long")))
    before = Window.partitionBy("request_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.least("size", F.lit(item))).over(before), F.lit(0))
    pool = F.greatest(F.least(F.lit(most), F.col("left")) - spent, F.lit(0))
    plan = plan.withColumn("got", F.least("size", F.lit(item), pool).cast("long")).select(*keep)
    bad = rows.where("__refused IS NOT NULL").select("request_id", "ordinal", "ref", kind_of(F.col("ref")).alias("kind"), F.col("__refused").alias("status"))
    plan = scratch.cut(plan.unionByName(bad, allowMissingColumns=True), "read-plan")
    cut_short = F.when(F.col("got") < F.col("size"), F.struct("ordinal", (F.col("first") + F.col("got")).alias("start")))
    told = plan.where("got IS NOT NULL").groupBy("request_id").agg(
        F.array_sort(F.collect_list(cut_short)).alias("at"), F.sum("got").alias("returned"), F.min("left").alias("__left"), F.min("request").alias("request"),
    )
    told = told.withColumn("left", F.col("__left") - F.col("returned"))
    json = F.to_json(F.struct("at", "left", "request"))
    token = F.translate(F.regexp_replace(F.base64(json.cast("binary")), "[\r\n]", ""), "+/", "-_")
    more = F.size("at") > 0
    ended = told.select(
        "request_id", F.when(more & (F.col("left") > 0), token).alias("cursor"), "returned", F.when(more & (F.col("returned") >= F.least(F.lit(most), F.col("__left"))), "output_budget_exhausted").alias("warning"),
    )
    ok = F.col("status") == "ok"
    items = _texts(plan, store).select(
        "request_id", "ordinal", "ref", "kind", "status", F.when(ok, F.substring("text", F.col("first").cast("int"), F.col("got").cast("int"))).alias("text"), F.when(ok, F.col("first")).alias("first"),
        F.when(ok, F.col("first") + F.col("got") - 1).alias("last"), F.coalesce(F.col("got") < F.col("size"), F.lit(False)).alias("truncated"), "digest", "locator", "citation",
    )
    return items, ended


def chain(wanted: DataFrame, store: DataFrame, *, most: int, most_refs: int = MAX_REFS) -> DataFrame:
    """All calls of a chain at once, for exports: what ``read`` gives call by call under ``most`` alone, until nothing is left.

    Call c (from 0) returns code points c * most and on of a request's windows put together, so every code point is returned once. Columns: request_id,
    call, ordinal, ref, kind, status, first, text, digest; a reference that can't be read has one row, in the call that gets to it. Requests that
    ``read`` refuses have their rows with call 0. A text is cut in one pass, whatever its length.
    """
    rows = _checked(wanted, most_refs)
    good, bad = rows.where("request IS NOT NULL AND request_id IS NOT NULL"), rows.where("request IS NULL OR request_id IS NULL")
    plan = _windowed(_measured(good, store), F.coalesce("start", F.lit(1).cast("long")))
    before = Window.partitionBy("request_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    plan = plan.select("request_id", "ordinal", "ref", "kind", "status", "first", "size", "before", "written_at")
    refused = bad.select("request_id", "ordinal", "ref", kind_of(F.col("ref")).alias("kind"), F.lit("invalid_request").alias("status"), F.lit(0).cast("long").alias("before"))
    rows = _texts(scratch.cut(plan.unionByName(refused, allowMissingColumns=True), "read-chain"), store)
    head = F.least("size", F.lit(most) - F.col("before") % most).cast("int")
    first = F.col("first").cast("int")
    rest = F.regexp_extract_all(F.substring("text", first + head, F.col("size").cast("int") - head), F.lit(f"(?s).{{1,{most}}}+"), F.lit(0))
    pieces = F.when(F.col("status") == "ok", F.concat(F.array(F.substring("text", first, head)), rest)).otherwise(F.array(F.lit(None).cast("string")))
    cut = rows.select("request_id", "ordinal", "ref", "kind", "status", "first", "before", "digest", head.alias("__head"), F.posexplode(pieces).alias("__i", "text"))
    start = F.col("first") + F.when(F.col("__i") == 0, 0).otherwise(F.col("__head") + (F.col("__i") - 1) * most)
    call = F.expr(f"before div {most}") + F.col("__i")
    return cut.select("request_id", call.alias("call"), "ordinal", "ref", "kind", "status", F.when(F.col("status") == "ok", start).alias("first"), "text", "digest")
