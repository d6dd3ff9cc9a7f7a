"""Turns read what they name from four stores: documents, parts as skills, regions as capabilities, events as captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestor.operators import reading as R
from attestor.plans.catalog import query, read

_PLACES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "NOWHERE")
_NOW = "2024-01-15"
MOST, ITEM, TOTAL, CHAINED = 1500, 600, 2500, 700


def _sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event was captured before, too, with another excerpt: the newest one answers."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ref"), "text", F.col("source").alias("locator"), F.concat("source", F.lit("#"), "doc_id").alias("citation"), _sha(F.col("text")).alias("digest"))
    key = F.col("p_partkey")
    skills = read(spark, sf_dir, "part").select(
        F.concat(F.lit("skill-"), key).alias("skill_id"), F.concat(F.lit("1.0."), key % 2).alias("version"), F.col("p_name").alias("summary"), F.col("p_brand").alias("domain"), F.concat(F.lit("skills/"), key, F.lit(".md")).alias("locator"), _sha(F.col("p_name")).alias("digest"),
    )
    capabilities = read(spark, sf_dir, "region").select(F.col("r_name").alias("capability_id"), F.lit("1.0.0").alias("version"), F.concat(F.lit("pkg:"), "r_name").alias("locator"), _sha(F.col("r_name")).alias("digest"))
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    told = F.repeat(F.concat(F.lit("a "), "event_type", F.lit(" of "), "user_id", F.lit(". ")), F.lit(60))
    page = lambda rows, excerpt, at: rows.select(
        F.concat(F.lit("live:"), "event_id").alias("ref"), excerpt.alias("excerpt"), F.concat(F.lit("https://example.org/"), "event_id").alias("locator"), F.concat(F.lit("captured "), "event_id").alias("citation"),
        _sha(excerpt).alias("digest"), at.alias("written_at"), F.date_add(F.lit(_NOW).cast("date"), (F.col("event_id") % 5 - 1).cast("int")).cast("timestamp").alias("expires_at"),
    )
    live = page(events, told, F.col("at")).unionByName(page(events.where("event_id % 2 = 0"), F.lit("what the page said before"), F.col("at") - F.expr("INTERVAL 1 DAY")))
    return R.stores(docs, skills, capabilities, live, F.lit(_NOW).cast("timestamp"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, of = F.col("conv_id") * 7 + F.col("turn"), F.expr("(conv_id * 7 + turn) div 4")
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (of % 5 + 1).cast("int"))
    ref = (
        F.when(n % 4 == 0, of.cast("string")).when(n % 4 == 1, F.concat(F.lit("skill:skill-"), of, F.lit("@1.0."), n % 3))
        .when(n % 4 == 2, F.concat(F.lit("capability:"), place)).otherwise(F.concat(F.lit("live:"), of))
    )
    part = n % 5 == 0
    return read(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", F.expr("turn div 8")).alias("request_id"), (F.col("turn") % 8).cast("long").alias("ordinal"), ref.alias("ref"), F.when(part, 1 + F.col("turn") * 40).alias("start"), F.when(part, 900 + F.col("turn") * 40).alias("end"),
    )


_S = f"""wn AS (SELECT conv_id || '-' || (turn // 8) AS request_id, (turn % 8)::BIGINT AS ordinal, conv_id * 7 + turn AS n, (conv_id * 7 + turn) // 4 AS k, CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 1 + turn * 40 END AS a, CASE WHEN (conv_id * 7 + turn) % 5 = 0 THEN 900 + turn * 40 END AS b FROM conversations),
    wt AS (SELECT request_id, ordinal, a, b, CASE n % 4 WHEN 0 THEN k::VARCHAR WHEN 1 THEN 'skill:skill-' || k || '@1.0.' || (n % 3) WHEN 2 THEN 'capability:' || {list(_PLACES)}[k % 5 + 1] ELSE 'live:' || k END AS ref, ['local', 'skill', 'capability', 'live'][n % 4 + 1] AS kind FROM wn),
    sk AS (SELECT 'skill-' || p_partkey AS i, '1.0.' || (p_partkey % 2) AS v, 'skills/' || p_partkey || '.md' AS l, 'sha256:' || sha256(p_name) AS d, p_name, p_brand FROM part),
    st AS (SELECT doc_id::VARCHAR AS ref, text, 'sha256:' || sha256(text) AS digest, source || '#' || doc_id AS citation, false AS gone FROM documents
           UNION ALL SELECT 'skill:' || i || '@' || v, to_json({{'digest': d, 'domain': p_brand, 'locator': l, 'skill_id': i, 'summary': p_name, 'version': v}})::VARCHAR, d, i || '@' || v, false FROM sk
           UNION ALL SELECT 'capability:' || r_name, to_json({{'capability_id': r_name, 'digest': 'sha256:' || sha256(r_name), 'locator': 'pkg:' || r_name, 'version': '1.0.0'}})::VARCHAR, 'sha256:' || sha256(r_name), r_name || '@1.0.0', false FROM region
           UNION ALL SELECT 'live:' || event_id, repeat('a ' || event_type || ' of ' || user_id || '. ', 60), 'sha256:' || sha256(repeat('a ' || event_type || ' of ' || user_id || '. ', 60)), 'captured ' || event_id, event_id % 5 = 0 FROM events),
    fp AS (SELECT request_id, sum(('0x' || substr(sha256(ordinal || '|' || ref || '|' || coalesce(a::VARCHAR, '') || '|' || coalesce(b::VARCHAR, '')), 1, 8))::BIGINT)::BIGINT::VARCHAR AS request FROM wt GROUP BY 1),
    mm AS (SELECT wt.*, text, digest, citation, coalesce(a, 1)::BIGINT AS first, least(coalesce(b, length(text)), length(text)) AS e, gone FROM wt LEFT JOIN st USING (ref)),
    ms AS (SELECT *, CASE WHEN text IS NULL THEN 'missing_ref' WHEN gone THEN 'expired_ref' WHEN first > length(text) OR e < first THEN 'invalid_range' ELSE 'ok' END AS status FROM mm),
    mz AS (SELECT *, CASE WHEN status = 'ok' THEN e - first + 1 ELSE 0 END AS size FROM ms)"""


def _call(n: int, left: str) -> str:
    """What a call takes of rows r{n} (first, size) and how its requests stand after it."""
    prior = f"coalesce(sum(least(size, {ITEM})) OVER (PARTITION BY request_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"""c{n} AS (SELECT *, least(size, {ITEM}, greatest(least({MOST}, {left}) - {prior}, 0))::BIGINT AS got FROM r{n}),
    e{n} AS (SELECT request_id, any_value({left}) - sum(got)::BIGINT AS lft, sum(got) AS returned, any_value({left}) AS had, list({{'ordinal': ordinal, 'start': (first + got)::BIGINT}} ORDER BY ordinal) FILTER (got < size) AS cuts FROM c{n} GROUP BY 1),
    t{n} AS (SELECT e{n}.request_id, CASE WHEN cuts IS NOT NULL AND lft > 0 THEN translate(to_base64(to_json({{'at': cuts, 'left': lft::BIGINT, 'request': request}})::VARCHAR::BLOB), '+/', '-_') END AS cursor, CASE WHEN cuts IS NOT NULL AND returned >= least({MOST}, had) THEN 'output_budget_exhausted' END AS warning FROM e{n} JOIN fp USING (request_id)),
    o{n} AS (SELECT request_id, {n} AS call, ordinal, ref, kind, status, CASE WHEN status = 'ok' THEN substr(text, first, got) END AS text, CASE WHEN status = 'ok' THEN first END AS first, CASE WHEN status = 'ok' THEN first + got - 1 END AS last, got < size AS truncated, CASE WHEN status = 'ok' THEN digest END AS digest, CASE WHEN status = 'ok' THEN citation END AS citation, cursor, warning FROM c{n} JOIN t{n} USING (request_id))"""


@query("store_reads", f"""WITH {_S}, r1 AS (SELECT * FROM mz), {_call(1, f'{TOTAL}::BIGINT')},
    r2 AS (SELECT c1.* EXCLUDE (got, first, size), first + got AS first, size - got AS size, lft FROM c1 JOIN e1 USING (request_id) WHERE got < size AND lft > 0), {_call(2, 'lft')} SELECT * FROM o1 UNION ALL SELECT * FROM o2""")  # fmt: skip
def store_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every request, and the call that its cursor resumes."""
    wanted, store = _wanted(spark, sf_dir), _stores(spark, sf_dir)
    said, cursors = R.read(wanted, store, most=MOST, item=ITEM, total=TOTAL)
    more, after = R.read(wanted, store, most=MOST, item=ITEM, total=TOTAL, cursors=cursors)
    told = lambda n, items, ended: items.join(ended.drop("returned"), "request_id").withColumn("call", F.lit(n))
    out = told(1, said, cursors).unionByName(told(2, more, after))
    return out.select("request_id", F.col("call").cast("long").alias("call"), "ordinal", "ref", "kind", "status", "text", "first", "last", "truncated", "digest", "citation", "cursor", "warning")


@query("read_chain", f"""WITH {_S}, b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY request_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM mz),
    u AS (SELECT *, unnest(range(before // {CHAINED}, (before + greatest(size, 1) - 1) // {CHAINED} + 1)) AS call FROM b), g AS (SELECT *, greatest(call * {CHAINED}, before) AS f, least((call + 1) * {CHAINED}, before + size) AS t FROM u)
    SELECT request_id, call, ordinal, ref, kind, status, CASE WHEN status = 'ok' THEN first + f - before END AS first, CASE WHEN status = 'ok' THEN t - f END AS chars, CASE WHEN status = 'ok' THEN sha256(substr(text, (first + f - before)::BIGINT, (t - f)::BIGINT)) END AS sha256 FROM g""")  # fmt: skip
def read_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every chain of calls, until nothing is left."""
    out = R.chain(_wanted(spark, sf_dir), _stores(spark, sf_dir), most=CHAINED)
    return out.select("request_id", "call", "ordinal", "ref", "kind", "status", "first", F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("sha256"))
