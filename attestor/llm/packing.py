"""Harmonic packing of documents into sequences of a fixed capacity C.

Class k holds pieces of length in (C/(k+1), C/k]; a sequence of class k gets exactly k of them. Classes never mix, so each
worker numbers its own pieces per class without talking to others; a prefix sum over the small table of counts per (task, class)
turns local numbers into global ones, and number // k is the sequence. Nothing is sorted by size and no task sees a
class as a whole.

Documents may be cut freely, so they are cut where the classes end: the largest floor(C/k) that fits, again and again. The rest
after such a cut is below length²/C, so a document gets few pieces, and a full sequence of class k lacks at most C mod k
ids. At the end each class has at most k - 1 pieces left over; those (fewer than C(1 + ln C) in all, whatever the
input) are placed by first fit on the driver.

Defined cases: null text is empty and packs as the end id alone; repeated rows are separate documents; an empty table gives an
empty result; input columns named like an output column are replaced by it. The numbering is written to the shared folder before it is
used, so a task that runs twice can't give a piece two places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from attestor import scratch
from attestor.llm import tokens

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A piece's class, its number among those of the class that its task has made, and the task.
NUMBERED = ("__class", "__nth", "__task")
OWN = ("sequence_id", "offset")


def class_lengths(capacity: int) -> list[int]:
    """The longest piece of each class, longest first."""
    return sorted({capacity // k for k in range(1, capacity + 1)}, reverse=True)


def cuts(capacity: int) -> list[tuple[int, ...]]:
    """For each length below the capacity, the pieces it is cut into."""
    lengths, out = class_lengths(capacity), [()]
    fits = [0] * capacity
    for size in reversed(lengths[1:]):
        fits[size:] = [size] * (capacity - size)
    for n in range(1, capacity):
        out.append((fits[n], *out[n - fits[n]]))
    return out


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces in the columns of PIECE and NUMBERED; with_ids adds the ids, little-endian unsigned 32-bit."""
    schema = PIECE + "".join(f", {c} long" for c in NUMBERED) + ", ids binary" * with_ids

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table, end = tokens.encoder(tokenizer), cuts(capacity), END_ID.to_bytes(4, "little")
        seen, task = [0] * (capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n, start = len(ids) // 4, 0
                for size in [capacity] * (n // capacity) + [*table[n % capacity]]:
                    part = ids[4 * start : 4 * (start + size)]
                    k = capacity // size
                    rows.append((doc, start, size, zlib.crc32(part), n, k, seen[k], task, *([part] if with_ids else [])))
                    start += size
                    seen[k] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * (8 + with_ids)
            kinds = [pa.int64()] * 8 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def _number(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the task and the piece's number among those of its class that this task has seen."""
    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId()
    for pdf in batches:
        before = pdf["__class"].map(seen).fillna(0).astype("int64")
        pdf["__nth"] = pdf.groupby("__class").cumcount() + before
        pdf["__task"] = task
        for k, n in pdf["__class"].value_counts().items():
            seen[k] = seen.get(k, 0) + n
        yield pdf


def plan(totals: dict[int, int], capacity: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int, int, int]]]:
    """Per class its first sequence and its number of pieces in full ones; (class, piece, sequence, slot, offset) of those left over, the offset if all are as long as their class allows."""
    full, following = {}, 0
    for k in sorted(totals):
        full[k] = (following, totals[k] // k * k)
        following += totals[k] // k
    left, room, used = [], [], []
    for k in sorted(totals):  # longest first
        size, at = capacity // k, 0
        for nth in range(full[k][1], totals[k]):
            while at < len(room) and room[at] < size:
                at += 1
            if at == len(room):
                room.append(capacity)
                used.append(0)
            left.append((k, nth, following + at, used[at], capacity - room[at]))
            room[at] -= size
            used[at] += 1
    return full, left


def pack(df: DataFrame, *, capacity: int = 2048, length: str = "length") -> DataFrame:
    """``df`` (a row per piece, lengths from 1 to the capacity) with sequence_id and offset; pieces that aren't numbered yet are numbered here."""
    kept = [f for f in df.schema.fields if f.name.lower() not in (*OWN, *NUMBERED)]
    whole = set(NUMBERED) <= set(df.columns)  # pieces that were cut to their class's length
    if whole:
        made = df.select(*(f"`{f.name}`" for f in kept), *NUMBERED)
    else:
        own = T.StructType([*kept, *(T.StructField(c, T.LongType()) for c in NUMBERED)])
        classed = df.select(*(f"`{f.name}`" for f in kept), F.floor(F.lit(capacity) / F.col(f"`{length}`")).cast("long").alias("__class"))
        made = classed.mapInPandas(_number, own)
    with scratch.small_batches(df.sparkSession):
        numbered = scratch.cut(made, "packing")
    counts = numbered.groupBy("__task", "__class").agg((F.max("__nth") + 1).alias("__n"))
    totals = {r[0]: r[1] for r in counts.groupBy("__class").agg(F.sum("__n")).collect()}  # as many rows as classes
    full, left = plan(totals, capacity)
    spark = df.sparkSession
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(Window.partitionBy("__class").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    firsts = spark.createDataFrame([(k, a, n) for k, (a, n) in full.items()], "__class long, __first long, __full long")
    rest = spark.createDataFrame(left, "__class long, __global long, __seq long, __slot long, __at long")
    # both tables have bounds that depend on the capacity alone
    rows = numbered.join(base.select("__task", "__class", "__base"), ["__task", "__class"]).join(F.broadcast(firsts), "__class")
    rows = rows.withColumn("__global", F.col("__base") + F.col("__nth")).join(F.broadcast(rest), ["__class", "__global"], "left")
    rows = rows.withColumn("sequence_id", F.coalesce("__seq", F.col("__first") + F.expr("__global div __class")))
    rows = rows.withColumn("__slot", F.coalesce("__slot", F.col("__global") % F.col("__class")))
    if whole:  # those of a sequence are equally long, or were placed on the driver: no exchange
        offset = F.coalesce("__at", F.col("__slot") * F.col(f"`{length}`"))
    else:
        before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum(F.col(f"`{length}`")).over(before), F.lit(0))
    rows = rows.withColumn("offset", offset.cast("long"))
    return rows.select(*(f"`{f.name}`" for f in kept), *OWN)


def sequences(packed: DataFrame) -> DataFrame:
    """Sequences (sequence_id, ids, documents) of pieces packed with their ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(ordered.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return grouped.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("documents"))
