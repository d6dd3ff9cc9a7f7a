"""Streaming extensions over events, run to the end of what is there, and the markdown splitter over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attestor import scratch
from attestor.plans.catalog import query, read
from attestor.plans.research import DEADLINE_MS, deadline_sql
from attestor.sources.markdown import MarkdownPassages
from attestor.streaming import live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; one table may be a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def _settled(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """The stream's result once all input is read; each batch of a complete result replaces the one before it."""
    spark = stream.sparkSession
    path, names = scratch.new_path(spark, label), stream.schema

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    run = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(names).parquet(path)


@query("stream_audit_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS calls FROM events GROUP BY ALL")
def stream_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _settled(live.audit_counts(_events(spark, sf_dir), "event_type"), "complete", "audit-counts")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", F.col("count").alias("calls"))


@query("stream_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, count(*) AS calls, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start FROM s GROUP BY user_id, n""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _settled(live.sessions(_events(spark, sf_dir), "user_id"), "complete", "sessions")
    return out.select("user_id", F.col("count").alias("calls"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query("stream_first_fetches", "SELECT DISTINCT user_id FROM events")
def stream_first_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(live.fresh_fetches(_events(spark, sf_dir), "user_id").select("user_id"), "append", "first-fetches")


@query("stream_ledger", """WITH c AS (SELECT event_id, user_id, ts, event_type = 'view' AS cached, floor(value * 10)::BIGINT + 500 AS bytes FROM events),
    p AS (SELECT *, coalesce(sum(CASE WHEN cached THEN 0 ELSE 1 END) OVER w, 0) AS rq, coalesce(sum(CASE WHEN cached THEN 0 ELSE bytes END) OVER w, 0) AS b FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, event_id, greatest(10 - rq, 0)::BIGINT AS requests_left, greatest(9000 - b, 0)::BIGINT AS bytes_left, CASE WHEN cached THEN 'cached' WHEN rq > 9 OR 9000 - b < 1024 THEN 'network_budget_exhausted' ELSE 'fetch' END AS decision FROM p""")  # fmt: skip
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running balance of each user's calls, kept as state."""
    calls = _events(spark, sf_dir).select(
        F.col("user_id").alias("investigation"), F.col("event_id").alias("seq"), "at", (F.floor(F.col("value") * 10) + 500).cast("long").alias("bytes"), (F.col("event_type") == "view").alias("cached"),
    )
    out = _settled(live.ledger(calls, 10, 9000), "append", "ledger")
    return out.select(F.col("investigation").alias("user_id"), F.col("seq").alias("event_id"), "requests_left", "bytes_left", "decision")


@query("stream_deadlines", deadline_sql("ts, event_id"))
def stream_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, bytes and time of each user's calls, kept as state."""
    calls = _events(spark, sf_dir).select(
        F.col("user_id").alias("investigation"), F.col("event_id").alias("seq"), "at", (F.floor(F.col("value") * 10) + 500).cast("long").alias("bytes"), (F.col("event_id") * 37 % 400).alias("elapsed_ms"), (F.col("event_type") == "view").alias("cached"),
    )
    out = _settled(live.timed_ledger(calls, 10, 9000, DEADLINE_MS), "append", "deadlines")
    return out.select(F.col("investigation").alias("user_id"), F.col("seq").alias("event_id"), "requests_left", "bytes_left", "ms_left", "ms_charged", "timed_out", "decision", "exhausted")


@query("markdown_passages", """WITH d AS (SELECT doc_id, lang, replace(replace(text, '#', ''), chr(10), ' ') AS t FROM documents)
    SELECT doc_id, 'One' AS heading, 0 AS ordinal, 3 AS start_line, 4 AS end_line, '# One' || chr(10) || t || chr(10) AS text FROM d UNION ALL SELECT doc_id, 'One/Two', 0, 5, 6, '## Two' || chr(10) || lang || chr(10) FROM d
    UNION ALL SELECT doc_id, 'One', 1, 7, 7, '# One' || chr(10) FROM d UNION ALL SELECT doc_id, '', 0, 1, 2, 'intro' || chr(10) || chr(10) FROM d""")  # fmt: skip
def markdown_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document under headings: the splitter's paths, ordinals and line numbers."""
    flat = F.replace(F.replace(F.col("text"), F.lit("#"), F.lit("")), F.lit("\n"), F.lit(" "))
    body = F.concat(F.lit("intro\n\n# One\n"), flat, F.lit("\n## Two\n"), F.col("lang"), F.lit("\n# One\n"))
    docs = read(spark, sf_dir, "documents").select("doc_id", body.cast("binary").alias("content"))
    rows = docs.lateralJoin(MarkdownPassages(F.concat(F.col("doc_id").cast("string").outer(), F.lit(".md")), F.col("content").outer()))
    return rows.select("doc_id", F.array_join("heading_path", "/").alias("heading"), "ordinal", "start_line", "end_line", "text")
