"""Best-fit packing of documents into sequences of a fixed capacity C, planned on the histogram of lengths.

A document longer than C is cut into pieces of C ids and a rest; any other is one piece. The plan sees only how many pieces there are of each length
(at most C numbers, whatever the input): lengths from long to short, each piece into the fullest sequence that still has room, a new one if
there is none (best-fit decreasing). All pieces of a length are placed at once: sequences that are filled alike form a run, so the plan is a short table of

    length, first rank, pieces, pieces in each sequence, first sequence, offset in it

in which pieces with ranks from ``first rank`` on go to one sequence after the other. A run is split only where a length ends within it, so there are
at most a few runs a length, and a run meets at most as many lengths as fit into one sequence.

Pieces get their rank within their length without meeting: each task numbers its own, a prefix sum over the counts per (task, length) makes the
numbers global, and a join on length and rank gives each piece its place. Ids are not moved. The numbering is written to the shared
folder before it is used, so a task that runs twice can't give a piece two places.

Defined cases: null text is empty and packs as the end id alone; repeated rows and ties are documents of their own; an empty table gives an empty result;
input columns other than doc_id and text are left out, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from attestor import scratch
from attestor.llm import tokens

END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
OWN = ("sequence_id", "offset")


class Run(NamedTuple):
    """``per`` pieces in each of some sequences that were filled up to ``offset``, but for the last one, which may get fewer."""

    length: int
    first: int
    pieces: int
    per: int
    sequence: int
    offset: int


def plan(counts: Mapping[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over the number of pieces of each length; ranks and sequences count from 0."""
    runs: list[Run] = []
    room: dict[int, list[tuple[int, int]]] = {}  # sequences with so much room left: (first, how many)
    opened = 0
    for length in sorted(counts, reverse=True):
        left, first = counts[length], 0
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        for space in sorted(s for s in room if s >= length):
            per, groups = space // length, room.pop(space)
            while groups and left:
                sequence, n = groups.pop()
                full = min(n, left // per)
                some = left - full * per if full < n and left < n * per else 0  # fewer than per, in one more sequence
                placed = full * per + some
                runs.append(Run(length, first, placed, per, sequence, capacity - space))
                if full:
                    room.setdefault(space - per * length, []).append((sequence, full))
                if some:
                    room.setdefault(space - some * length, []).append((sequence + full, 1))
                if (used := full + bool(some)) < n:
                    groups.append((sequence + used, n - used))
                first, left = first + placed, left - placed
            if groups:
                room.setdefault(space, []).extend(groups)
            if not left:
                break
        if left:
            per = capacity // length
            full, some = divmod(left, per)
            runs.append(Run(length, first, left, per, opened, 0))
            if full:
                room.setdefault(capacity - per * length, []).append((opened, full))
            if some:
                room.setdefault(capacity - some * length, []).append((opened + full, 1))
            opened += full + bool(some)
    return runs


def pieces(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces in the columns of PIECE, with their number among those of the length that their task has made; with_ids adds the ids, little-endian unsigned 32-bit."""
    schema = f"{PIECE}, __nth long, __task long" + ", ids binary" * with_ids

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens.word_encoder(tokenizer), END_ID.to_bytes(4, "little")
        seen, task = [0] * (capacity + 1), TaskContext.get().partitionId()
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5] + [pa.binary()] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(part), seen[n], task, *([part] if with_ids else [])))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def pack(made: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """The rows of ``pieces`` with sequence_id and offset, without __nth and __task."""
    spark = made.sparkSession
    with scratch.small_batches(spark):
        numbered = scratch.cut(made, "bestfit")
    counts = scratch.cut(numbered.groupBy("__task", "length").agg(F.count("*").alias("__n")), "bestfit-counts")
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__task", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    planned = spark.createDataFrame(plan(totals, capacity), "length long, __first long, __pieces long, __per long, __sequence long, __offset long")
    rows = numbered.join(base, ["__task", "length"]).withColumn("__rank", F.col("__base") + F.col("__nth"))
    # the plan's size depends on the capacity alone
    mine = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__pieces"))
    rows = rows.join(F.broadcast(planned.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & mine)
    nth = F.col("__rank") - F.col("__first")
    placed = rows.withColumn("sequence_id", F.col("__sequence") + F.floor(nth / F.col("__per")).cast("long")).withColumn("offset", F.col("__offset") + nth % F.col("__per") * F.col("length"))
    return placed.select(*(c for c in made.columns if c not in ("__nth", "__task")), *OWN)
