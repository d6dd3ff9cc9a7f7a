"""The live-evidence cache and the audit trail as tables: writing, reading by reference, pruning, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from attestor import scratch

#: The closed fields of an audit line.
AUDIT = T.StructType([
    T.StructField("bytes_transferred", T.LongType()), T.StructField("code", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("destination_class", T.StringType()),
    T.StructField("destination_host", T.StringType()), T.StructField("elapsed_ms", T.LongType()), T.StructField("request_id", T.StringType()), T.StructField("timestamp", T.StringType()),
])
FLOOR_BYTES = 1024


def live_ref(body: Column) -> Column:
    """The reference of a captured body: half of its digest."""
    return F.concat(F.lit("live:sha256:"), F.substring(F.sha2(body, 256), 1, 32))


def written(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache after entries (cache_key, seq, ref, bytes, retrieved_at, expires_at) were written in order of seq: the last of a key stays.

    A write also sweeps what had expired when the newest entry was retrieved, so the cache bounds itself.
    """
    last = Window.partitionBy("cache_key").orderBy(F.desc("new"), F.desc("seq"))
    rows = cache.withColumn("new", F.lit(0)).unionByName(entries.withColumn("new", F.lit(1)))
    rows = rows.withColumn("r", F.row_number().over(last)).where("r = 1").drop("r", "new")
    clock = entries.agg(F.max("retrieved_at").alias("clock"))
    return rows.crossJoin(F.broadcast(clock)).where(F.col("clock").isNull() | ~F.coalesce(F.col("clock") > F.col("expires_at"), F.lit(False))).drop("clock")  # one row


def prunable(now: Column, ttl_seconds: int) -> Column:
    """Corrupt (no expiry), expired, or with more life left than any entry is given."""
    left = F.unix_timestamp("expires_at") - F.unix_timestamp(now)
    return F.col("expires_at").isNull() | (now > F.col("expires_at")) | (left > ttl_seconds)


def stats(cache: DataFrame, now: Column, *by: str) -> DataFrame:
    """entries, expired and total_bytes; a corrupt entry takes space but is never expired."""
    return cache.groupBy(*by).agg(F.count("*").alias("entries"), F.count_if(now > F.col("expires_at")).alias("expired"), F.sum("bytes").alias("total_bytes"))


def prune_summary(cache: DataFrame, now: Column, ttl_seconds: int, *by: str) -> DataFrame:
    gone = prunable(now, ttl_seconds)
    return cache.groupBy(*by).agg(F.count("*").alias("scanned"), F.count_if(gone).alias("removed"), F.count_if(F.col("expires_at").isNull()).alias("corrupt"), F.sum(F.when(gone, F.col("bytes")).otherwise(0)).alias("bytes_reclaimed"))


def by_ref(refs: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """(ref, cache_key, state): of the entries that carry a reference the first by key; expired ones are reported, not served."""
    known = cache.where("expires_at IS NOT NULL").groupBy("ref").agg(F.min(F.struct("cache_key", "expires_at")).alias("e"))
    rows = refs.select("ref").distinct().join(known, "ref", "left")
    return rows.select("ref", F.when(F.col("e.expires_at") >= now, F.col("e.cache_key")).alias("cache_key"), F.when(F.col("e").isNull(), "miss").when(now > F.col("e.expires_at"), "expired").otherwise("hit").alias("state"))


def append_audit(records: DataFrame, path: str) -> None:
    """Appends records (the columns of AUDIT) as JSON lines; earlier ones are never touched."""
    records.select(*(F.col(f.name).cast(f.dataType) for f in AUDIT)).write.mode("append").option("ignoreNullFields", "false").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The trail; a line that isn't an object of exactly the closed fields raises when it is read."""
    lines = spark.read.text(path).where("value <> ''")
    keys = F.coalesce(F.array_sort(F.json_object_keys("value")), F.array().cast("array<string>"))
    closed = keys == F.array(*(F.lit(f.name) for f in AUDIT))
    checked = F.when(closed, F.from_json("value", AUDIT)).otherwise(F.raise_error(F.lit("corrupt_audit_record")).cast(AUDIT))
    return lines.select(checked.alias("r")).select("r.*")


def allowance(pool: DataFrame) -> DataFrame:
    """What the next call of each pool (requests_left, bytes_left, ms_left and the declared max_requests, max_bytes, max_ms) may spend; nulls where it can't be funded."""
    dry = (F.col("requests_left") < 1) | (F.col("bytes_left") < FLOOR_BYTES) | (F.col("ms_left") < 1)
    narrowed = lambda most, left, name: F.when(~dry, F.least(most, left)).alias(name)
    kept = [c for c in pool.columns if c not in ("requests_left", "bytes_left", "ms_left", "max_requests", "max_bytes", "max_ms")]
    return pool.select(*kept, narrowed("max_requests", "requests_left", "requests"), narrowed("max_bytes", "bytes_left", "bytes"), narrowed("max_ms", "ms_left", "ms"), (~dry).alias("funded"))


def append_new(rows: DataFrame, path: str, key: str, schema: T.StructType | None = None) -> DataFrame:
    """Resumable sink: appends the rows whose key isn't in the JSON lines of ``path`` yet, a torn last line counting as absent; gives what was appended."""
    spark = rows.sparkSession
    try:
        done = spark.read.schema(schema or rows.schema).option("mode", "DROPMALFORMED").json(path).select(key)
    except Exception as error:  # noqa: BLE001  only a folder that isn't there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = rows.select(key).limit(0)
    new = scratch.cut(rows.join(scratch.cut(done.where(F.col(key).isNotNull()).distinct(), "done"), key, "left_anti"), "new-rows")
    new.write.mode("append").json(path)
    return new
