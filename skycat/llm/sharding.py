"""Operator 10 (native): rendezvous hashing of stable record keys over weighted shards.

A record's score on shard s is -ln(u) / weight(s), u a uniform number from the hash of
(key, s); the smallest score wins.  Scores on other shards do not change when a shard
is added, so a record moves only into the new one.  Law ``key``: the record key and
the shards decide, nothing else.

Slots are gapless in each shard without a window over the shard: records are numbered
inside (shard, 1/4096 of the hash range) and shifted by the running sum of the counts
of the ranges before.  Only (key, size, checksum) rows are shuffled, never the text.

Defined cases: null doc_id (its own key), null text (size 1, crc32 0), equal texts
(placed by their own doc_id), repeated rows (one shard, slots of their own), empty
tables (empty result), extra columns (ignored).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

N_SHARDS = 16
RANGE_HEX = 3  # hash ranges of a shard: 16 ** 3


def _score(key: Column, shard: int, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
    return -F.ln((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the smallest score; ties to the smaller shard."""
    best = F.least(*[F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]) if sum(
        w > 0 for w in weights
    ) > 1 else F.struct(F.lit(0.0).alias("score"), F.lit(next(s for s, w in enumerate(weights) if w > 0)).alias("shard"))
    return best


def record_key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def sharded(docs: DataFrame, weights: list[float] | None = None, added_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (the shard with one more shard of ``added_weight``)."""
    weights = weights or [1.0] * N_SHARDS
    key = record_key(F.col("doc_id"))
    d = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    d = d.withColumn("best", shard_of(key, weights)).withColumn("h", F.md5(key))
    grown = F.when(_score(key, len(weights), added_weight) < F.col("best.score"), F.lit(len(weights))).otherwise(F.col("best.shard"))
    d = d.select(
        "doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), grown.cast("int").alias("grown_shard"), "h",
        F.substring("h", 1, RANGE_HEX).alias("range"),
    )
    counts = d.groupBy("shard", "range").agg(F.count("*").alias("n"))
    starts = counts.select(
        F.col("shard").alias("s_shard"),
        F.col("range").alias("s_range"),
        F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
    )
    nth = F.row_number().over(Window.partitionBy("shard", "range").orderBy("h", "doc_id", "size", "text_crc32"))
    numbered = d.withColumn("nth", nth)
    j = numbered.join(starts, (F.col("shard") == F.col("s_shard")) & (F.col("range") == F.col("s_range")))
    return j.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"
    )


def op10_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
