"""Sharding by jump consistent hashing, in DataFrame operations only.

A key's shard is found by a short walk of a 64-bit linear congruential generator that is
seeded with the key: no ring table, and one more shard takes rows only into itself.
Spark's long arithmetic raises on overflow, so the generator's state is held as two
32-bit halves and multiplied by parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_C_HIGH, _C_LOW = divmod(2862933555777941757, 1 << 32)
_M = 0xFFFFFFFF
BUCKETS = 4096


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * 2862933555777941757 + 1 mod 2**64."""
    m = F.lit(_M)
    x = (low.bitwiseAND(F.lit(0xFFFF))) * F.lit(_C_LOW)
    y = F.shiftright(low, 16) * F.lit(_C_LOW)
    bottom = x + F.shiftleft(y.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    carry = F.shiftright(bottom, 32) + F.shiftright(y, 16)
    cross = (low * F.lit(_C_HIGH)).bitwiseAND(m)
    top = (high.bitwiseAND(F.lit(0xFFFF)) * F.lit(_C_LOW)).bitwiseAND(m) + F.shiftleft((F.shiftright(high, 16) * F.lit(_C_LOW)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (carry + cross + top).bitwiseAND(m), bottom.bitwiseAND(m)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key among ``shards``; an int from 0.  The walk takes at most ``shards`` steps."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = key.cast("long")

    def state(high, low, at, to):
        return F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"), at.cast("long").alias("at"), to.cast("long").alias("to"))

    start = state(F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_M)), F.lit(-1), F.lit(0))

    def step(s, _):
        high, low = _next(s["high"], s["low"])
        to = F.floor((s["to"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1)))
        return F.when(s["to"] >= shards, s).otherwise(state(high, low, s["to"], to))

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["at"]).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    The law is ``key``: doc_id and the number of shards decide.  A null doc_id counts as
    key 0; rows with equal ids share a shard.  size is the text's UTF-8 bytes plus 1 and
    the checksum is that of the bytes; a null text has none (size 1, checksum 0).  Slots
    number the rows of a shard from 0 without gaps, in hashed order; identical rows take
    neighbouring slots.  Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), jump_hash(key, shards).alias("shard"), jump_hash(key, shards + 1).alias("grown_shard"))
    h = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    rows = materialize(rows.withColumn("h", h).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")))
    # two-level numbering: rows of the buckets before (BUCKETS a shard at most), then within a bucket
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "bucket", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32"))
    return rows.withColumn("within", within).join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within") - 1).cast("long").alias("slot"), "grown_shard")
