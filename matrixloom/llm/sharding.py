"""Sharding: weighted rendezvous hashing of stable record keys.

Every shard draws a number from the record's key and its own; the smallest draw, divided by the
shard's weight, has the record. A shard more only takes records into itself, and a shard less only
gives its own away. All columns are built-in expressions, and no text is moved: the draw, the size
and the checksum are taken where the row is read. The gapless slots come from counts by (input
partition, shard), added up over the partitions, plus a row number in each such cell; the largest
cell is one shard's share of one input partition.

Defined results: a null text has size 1 and the checksum of no bytes; a null doc_id is a key like
any other; repeated rows go to one shard with a slot each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrixloom.llm.common import cut, table


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u)/weight, where u in (0, 1) comes from 52 bits of a hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0")), F.lit(shard)), 12)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, from 0, of a record; weights: one positive number for each shard. Equal draws,
    which are next to impossible, go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    cells = [F.struct(draw(key, i, w).alias("d"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (cells[0] if len(cells) == 1 else F.least(*cells))["shard"]


def with_slots(df: DataFrame, shard: str, name: str) -> DataFrame:
    """df, written to the shared folder, with `slot`: 0, 1, ... in each shard."""
    placed = cut(df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), name)
    counts = placed.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition and shard
    before = F.sum("_n").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(shard, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part", shard).orderBy("_at")) - 1
    return placed.withColumn("_in", at).join(starts, ["_part", shard]).withColumn("slot", F.col("_before") + F.col("_in")).drop("_part", "_at", "_in", "_before")


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    out = with_slots(rows, "shard", "shards")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)
