"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**bits segments, at least one for each virtual node (where shards or rows outgrow it, it is refined, which moves keys once). Each shard owns ``vnodes`` segments picked by hash; a key belongs to the shard that
owns the first such segment clockwise from the key's own. A shard takes rows up to its bound; what arrives later
continues clockwise to the next shard with room.

"Arrival" has to be the same however the table is partitioned, so keys are hashed to cells (arrival wave, ring
segment) and cells arrive in that order, the rows of a cell by a second hash. That makes the sequential rule of
bounded loads a computation over cell *counts*: one narrow pass counts rows per cell, the driver walks the ring once and cuts each cell into rank
intervals, and a second pass ranks rows inside their cell and looks their interval up. The number of segments also follows the number of rows, so that a
cell holds some CELL_ROWS of them, up to 2**MAX_BITS; beyond, cells grow. No step handles a whole shard in one task: slots are the interval's base plus the rank.

Defined cases: a null key has no place of its own and is hashed by ``ties``; repeated rows are separate rows and take separate slots; rows that tie
in key and ``ties`` are interchangeable; an empty table gives an empty result; texts aren't read, so their length doesn't matter; input columns named like an output
column are replaced by it.
"""

from __future__ import annotations

import hashlib
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bits of the ring's segments at least and at most (what the driver gets is a row per cell, four times as many), and of arrival waves.
MIN_BITS, MAX_BITS, WAVE_BITS = 12, 20, 2
CELL_ROWS = 16_384
OWN = ("home_shard", "shard", "slot")


def bits_for(rows: int, shards: int, vnodes: int) -> int:
    """Enough segments for the virtual nodes, and for cells of a bounded size while they are not too many for the driver."""
    nodes, cells = ceil(log2(shards * vnodes)), ceil(log2(max(1, rows / CELL_ROWS))) - WAVE_BITS
    return max(MIN_BITS, nodes, min(MAX_BITS, cells))


def ring(shards: int, vnodes: int, seed: int, bits: int = MIN_BITS) -> list[int | None]:
    """Owner of each ring segment that carries a virtual node, else None; a shard's nodes don't depend on other shards' number, nor their order on that of segments."""
    owner: list[int | None] = [None] * (1 << bits)
    for shard in range(shards):
        for node in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{seed}:{shard}:{node}".encode(), digest_size=8).digest(), "big") >> (64 - bits)
            while owner[at] is not None:
                at = (at + 1) % len(owner)
            owner[at] = shard
    return owner


def clockwise(owner: list[int | None], shards: int) -> list[list[int]]:
    """For each segment, all shards in the order in which a walk clockwise from it meets them first."""
    around: list[list[int]] = [[]] * len(owner)
    order: list[int] = []
    for at in range(2 * len(owner) - 1, -1, -1):
        shard = owner[at % len(owner)]
        if shard is not None:
            order = [shard, *(s for s in order if s != shard)]
        if at < len(owner):
            around[at] = order
    assert all(len(x) == shards for x in around)
    return around


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold: the mean times 1 + slack, or with no slack counts that differ by one at most."""
    if slack:
        return [ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: dict[int, int], shards: int, vnodes: int, slack: float, seed: int, bits: int = MIN_BITS) -> list[tuple[int, int, int, int, int, int]]:
    """Walks the cells in arrival order; gives (cell, first rank, last rank, home shard, shard, slot of the first)."""
    if shards * vnodes > 1 << bits:
        raise ValueError(f"{shards} shards of {vnodes} virtual nodes exceed a ring of 2**{bits} segments")
    around = clockwise(ring(shards, vnodes, seed, bits), shards)
    room, held, out = bounds(sum(counts.values()), shards, slack), [0] * shards, []
    for cell in sorted(counts):
        rank, left, walk = 1, counts[cell], around[cell % (1 << bits)]
        for shard in walk:
            if take := min(left, room[shard] - held[shard]):
                out.append((cell, rank, rank + take - 1, walk[0], shard, held[shard]))
                rank, left, held[shard] = rank + take, left - take, held[shard] + take
            if not left:
                break
    return out


def cell_of(key: Column, seed: int, bits: int = MIN_BITS, ties: tuple[Column, ...] = ()) -> Column:
    """Arrival wave times segments plus ring segment, from independent bits of one hash."""
    code = F.xxhash64(F.lit(seed), key)
    if ties:
        code = F.when(key.isNull(), F.xxhash64(F.lit(seed), *ties)).otherwise(code)
    return F.shiftrightunsigned(code, 64 - bits - WAVE_BITS).cast("int")


def assign(df: DataFrame, key: str, shards: int, *, vnodes: int = 64, slack: float = 0.0, seed: int = 1, ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with home_shard (without bounds), shard and slot. ``ties``: columns that order rows of equal key."""
    bits = bits_for(df.count(), shards, vnodes)
    cell = cell_of(F.col(f"`{key}`"), seed, bits, tuple(F.col(f"`{c}`") for c in ties))
    counts = {r[0]: r[1] for r in df.groupBy(cell.alias("cell")).count().collect()}  # a row per cell
    plan = place(counts, shards, vnodes, slack, seed, bits)
    spark: SparkSession = df.sparkSession
    intervals = spark.createDataFrame(plan, "__cell int, __from long, __to long, home_shard int, shard int, __base long")
    order = [F.xxhash64(F.lit(seed + 1), F.col(f"`{key}`")), F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in ties)]
    taken = {c.lower() for c in OWN}
    kept = [c for c in df.columns if c.lower() not in taken]
    ranked = df.select(*(F.col(f"`{c}`") for c in kept), cell.alias("__cell"))
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy("__cell").orderBy(*order)).cast("long"))
    # a row per cell and shard at most (2**MAX_BITS cells for any number of rows), whatever the rows hold
    return (
        ranked.join(F.broadcast(intervals), "__cell")
        .where(F.col("__rank").between(F.col("__from"), F.col("__to")))
        .select(*(F.col(f"`{c}`") for c in kept), "home_shard", "shard", (F.col("__base") + F.col("__rank") - F.col("__from")).alias("slot"))
    )
