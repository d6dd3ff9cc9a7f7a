"""Telling rows whose key may be in a set from those whose key can't be, without moving either: a bitmap of hashed keys, 1 MB whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from attestor import scratch

#: Fixed, so that beyond some 10 million keys the filter only stops helping.
FILTER_BITS = 1 << 23


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with __hit: false only if their ``key`` isn't among that of ``keys``."""
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bitmap = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    bitmap = scratch.cut(bitmap, "key-filter")  # FILTER_BITS / 8 bytes at most
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "__bucket", "left")
    return found.select(*(F.col(f"`{c}`") for c in rows.columns), F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias("__hit"))
