"""Structured Streaming counterparts of the batch operators: extensions, as the operators they follow are batch only.

Sources are file streams; event times that come without a zone are cast to timestamps in the session's zone before a watermark is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestor.operators.research import FLOOR_BYTES, FLOOR_MS, FLOOR_REQUESTS


def events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A file stream with ``at``, its event time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("at", F.col("ts").cast("timestamp"))


def audit_counts(stream: DataFrame, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls per decision and window; windows close when the watermark passes them."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), by).count().select(F.col("window.start").alias("start"), by, "count")


def fresh_fetches(stream: DataFrame, key: str, ttl: str = "24 hours") -> DataFrame:
    """The first call of each key within the time to live: what a cache would have had to fetch."""
    return stream.withWatermark("at", ttl).dropDuplicatesWithinWatermark([key])


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("at", late).groupBy(F.session_window("at", gap), key).count().select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "count")


#: Parts of the index that a micro-batch may have to look into.
BUCKETS = 64


def index_new(stream: DataFrame, index_path: str, checkpoint: str, key: str = "ref") -> StreamingQuery:
    """Appends documents that the index doesn't hold, micro-batch by micro-batch. A batch that is run again finds its rows and adds none.

    The index is partitioned by a bucket of the key (column bucket), and a batch reads the keys of its own buckets only.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        try:
            mine = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS rows at most
            try:
                held = spark.read.parquet(index_path).where(F.col("bucket").isin(mine)).select(key)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                held = spark.createDataFrame([], rows.select(key).schema)
            rows.join(held, key, "left_anti").write.mode("append").partitionBy("bucket").parquet(index_path)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Balances are kept in plain arrays: an investigation may have few calls, and a frame's operations cost the same for one row as for thousands.
def _ordered(parts: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
    """An investigation's calls in the order of (at, seq), and which of them are live: a null cached is."""
    calls = pd.concat(parts, ignore_index=True)
    if len(calls) > 1:
        calls = calls.sort_values(["at", "seq"], kind="stable", ignore_index=True)
    return calls, calls["cached"].to_numpy(dtype=object) != True  # noqa: E712


def _whole(numbers: pd.Series) -> np.ndarray:
    return (numbers.fillna(0) if numbers.hasnans else numbers).to_numpy().astype("i8")


def ledger(stream: DataFrame, requests: int, most_bytes: int, late: str = "2 hours", idle: str = "24 hours") -> DataFrame:
    """Calls (investigation, seq, at, bytes, cached) with what was left before each and whether it was funded, as ``research.ledger`` tells for a batch.

    Calls of a micro-batch are charged in the order of (at, seq), after those of earlier ones. An investigation's state is two numbers; it goes once the
    watermark is past its last call by ``idle``, and calls after that have a pool of their own. A micro-batch's calls of one investigation meet in one task:
    the trigger's size bounds them. Null bytes are charged as none, a null cached as a live call; calls without an investigation share one pool.
    """
    held = int(pd.Timedelta(idle).total_seconds() * 1000)

    def charge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, live = _ordered(parts)
        spent, weight = state.get if state.exists else (0, 0)
        size = _whole(calls["bytes"]) * live
        requests_left = np.maximum(requests - spent - (np.cumsum(live) - live), 0)
        bytes_left = np.maximum(most_bytes - weight - (np.cumsum(size) - size), 0)
        denied = live & ((requests_left < FLOOR_REQUESTS) | (bytes_left < FLOOR_BYTES))
        state.update((spent + int(live.sum()), weight + int(size.sum())))
        state.setTimeoutTimestamp(max(int(calls["at"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + held)
        decision = np.where(live, np.where(denied, "network_budget_exhausted", "fetch"), "cached").astype(object)
        yield pd.DataFrame({"investigation": np.full(len(calls), key[0], dtype=object), "seq": calls["seq"], "requests_left": requests_left, "bytes_left": bytes_left, "decision": decision})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    found = f"investigation {kinds['investigation']}, seq {kinds['seq']}, requests_left long, bytes_left long, decision string"
    calls = stream.where("at IS NOT NULL").select("investigation", "seq", "at", "bytes", "cached").withWatermark("at", late)
    return calls.groupBy("investigation").applyInPandasWithState(charge, found, "requests long, bytes long", "append", GroupStateTimeout.EventTimeTimeout)


def timed_ledger(stream: DataFrame, requests: int, most_bytes: int, most_ms: int, late: str = "2 hours", idle: str = "24 hours") -> DataFrame:
    """``research.timed_ledger`` as state: calls (investigation, seq, at, bytes, elapsed_ms, cached), charged in the order of (at, seq) within a micro-batch.

    An investigation's state is three numbers, dropped as in ``ledger``; nulls count as they do in the batch.
    """
    held = int(pd.Timedelta(idle).total_seconds() * 1000)
    floors = {"requests": FLOOR_REQUESTS, "bytes": FLOOR_BYTES, "time": FLOOR_MS}
    most = {"requests": requests, "bytes": most_bytes, "time": most_ms}

    def charge(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        calls, live = _ordered(parts)
        takes = {"requests": live.astype("i8"), "bytes": _whole(calls["bytes"]) * live, "time": _whole(calls["elapsed_ms"])}
        spent = dict(zip(most, state.get if state.exists else (0, 0, 0), strict=True))

        def left() -> dict[str, np.ndarray]:
            return {n: np.maximum(most[n] - spent[n] - (np.cumsum(takes[n]) - takes[n]), 0) for n in most}

        before = left()
        denied = live & np.logical_or.reduce([before[n] < floors[n] for n in floors])
        takes = {n: np.where(denied, 0, took) for n, took in takes.items()}
        before = left()
        exhausted = np.full(len(calls), None, dtype=object)
        for name in reversed(floors):  # the first one that is under its floor is told
            exhausted[denied & (before[name] < floors[name])] = name
        state.update(tuple(int(spent[n] + takes[n].sum()) for n in most))
        state.setTimeoutTimestamp(max(int(calls["at"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs()) + held)
        decision = np.where(live, np.where(denied, "network_budget_exhausted", "fetch"), "cached").astype(object)
        yield pd.DataFrame({
            "investigation": np.full(len(calls), key[0], dtype=object), "seq": calls["seq"], "requests_left": before["requests"], "bytes_left": before["bytes"], "ms_left": before["time"],
            "ms_charged": np.minimum(takes["time"], before["time"]), "timed_out": live & ~denied & (takes["time"] > before["time"]), "decision": decision, "exhausted": exhausted,
        })

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    found = f"investigation {kinds['investigation']}, seq {kinds['seq']}, requests_left long, bytes_left long, ms_left long, ms_charged long, timed_out boolean, decision string, exhausted string"
    calls = stream.where("at IS NOT NULL").select("investigation", "seq", "at", "bytes", "elapsed_ms", "cached").withWatermark("at", late)
    return calls.groupBy("investigation").applyInPandasWithState(charge, found, "requests long, bytes long, ms long", "append", GroupStateTimeout.EventTimeTimeout)


def split_late(stream: DataFrame, out: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Every row under ``out``/rows, dealt by late (the words true and false) and batch (a number): late is what a watermark of that delay would drop without a word.

    A row is late if its event time trails the greatest of earlier micro-batches by more than the delay; rows without one are late too. A batch that is run
    again replaces its own rows, and reads only the mark that its predecessor left.
    """
    delay, at = int(pd.Timedelta(late) / pd.Timedelta("1us")), F.unix_micros("at")

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = spark.read.parquet(f"{out}/marks/{number - 1}").first()[0] if number else None
        held = batch.persist()
        try:
            on_time = F.col("at").isNotNull() if mark is None else F.coalesce(at >= mark - delay, F.lit(False))
            for name, rows in (("true", held.where(~on_time)), ("false", held.where(on_time))):
                rows.write.mode("overwrite").parquet(f"{out}/rows/late={name}/batch={number}")
            held.agg(F.greatest(F.max(at), F.lit(mark).cast("long")).alias("at")).write.mode("overwrite").parquet(f"{out}/marks/{number}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
