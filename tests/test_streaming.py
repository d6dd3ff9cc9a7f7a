from pyspark.sql import functions as F

from attestor.operators import research
from attestor.streaming import live

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
EVENTS = "/root/testdata/sf0.001/"


def run(query_df, spark, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark):
    rows = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "events.parquet").parquet(EVENTS)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def test_audit_counts_equal_the_batch(spark):
    got = run(live.audit_counts(stream(spark), "event_type"), spark, "audit_counts", "complete")
    total = spark.read.parquet(EVENTS + "events.parquet")
    assert got.agg({"count": "sum"}).first()[0] == total.count()
    assert got.select("event_type").distinct().count() == total.select("event_type").distinct().count()


def test_sessions_cover_all_events(spark):
    got = run(live.sessions(stream(spark), "user_id"), spark, "sessions", "complete")
    assert got.agg({"count": "sum"}).first()[0] == 1000


def test_first_fetches(spark):
    got = run(live.fresh_fetches(stream(spark), "user_id"), spark, "fresh", "append")
    assert got.count() == spark.read.parquet(EVENTS + "events.parquet").select("user_id").distinct().count()


def test_incremental_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "ref long, text string")
    for n in (6, 10):
        docs.where(f"ref < {n}").write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("ref long, text string").parquet(f"{tmp_path}/in")
        live.index_new(s, f"{tmp_path}/index", f"{tmp_path}/cp").awaitTermination(60)
        assert sorted(r.ref for r in spark.read.parquet(f"{tmp_path}/index").collect()) == list(range(n))


CALLS = "investigation long, seq long, at timestamp, bytes long, cached boolean"


def test_ledger_keeps_its_balance_across_batches(spark, tmp_path):
    rows = [(n % 2, n, f"2024-01-01 00:{n:02d}:00", None if n == 4 else 700 + n, None if n == 5 else n % 5 == 1) for n in range(40)] + [(None, 99, "2024-01-01 00:59:00", 9000, False)]
    calls = spark.createDataFrame(rows, "investigation long, seq long, at string, bytes long, cached boolean").withColumn("at", F.col("at").cast("timestamp"))
    got = []
    for low, high in ((0, 13), (13, 25), (25, 100)):  # three runs that share a checkpoint
        calls.where(f"seq >= {low} AND seq < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ran = live.ledger(spark.readStream.schema(CALLS).parquet(f"{tmp_path}/in"), 12, 9000).writeStream
        ran = ran.foreachBatch(lambda batch, _: got.extend(map(tuple, batch.collect()))).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        ran.awaitTermination(120)
    clean = calls.withColumn("bytes", F.coalesce("bytes", F.lit(0))).withColumn("cached", F.coalesce("cached", F.lit(False)))
    batch = research.ledger(clean, 12, 9000).select("investigation", "seq", "requests_left", "bytes_left", "decision").collect()
    assert sorted(got, key=lambda r: r[1]) == sorted(map(tuple, batch), key=lambda r: r[1])
    assert {r[4] for r in got} == {"fetch", "cached", "network_budget_exhausted"}


def test_ledger_of_an_empty_stream(spark, tmp_path):
    spark.createDataFrame([], CALLS).write.parquet(f"{tmp_path}/in")
    assert run(live.ledger(spark.readStream.schema(CALLS).parquet(f"{tmp_path}/in"), 1, 9000), spark, "no_calls", "append").count() == 0


def test_late_rows_are_told_apart_and_kept(spark, tmp_path):
    batches = [[(1, "2024-01-01 10:00:00"), (2, "2024-01-01 01:00:00")], [(3, "2024-01-01 07:59:59"), (4, "2024-01-01 08:00:00"), (5, None)], [(6, "2024-01-01 08:30:00"), (7, "2024-01-01 12:00:00")], [(8, "2024-01-01 09:59:59")]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.split_late(spark.readStream.schema("id long, at timestamp").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out/rows")
    assert sorted((r.id, r.late) for r in got.collect()) == [(1, "false"), (2, "false"), (3, "true"), (4, "false"), (5, "true"), (6, "false"), (7, "false"), (8, "true")]
