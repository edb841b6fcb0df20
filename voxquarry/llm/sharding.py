"""Sharding [native]: contiguous shards of near-equal bytes.

Global byte-size prefix sums are built from per-partition totals and cut at
equal targets.  Only identifiers, sizes and checksums are ever shuffled, never
texts, and no window spans the whole table:

1. a scan reduces each text to (order key, size, checksum) and stages that;
2. a range shuffle sorts the narrow rows and numbers the range partitions;
3. per-partition totals (a row for each partition) are summed up in order, which
   gives every partition its global offset;
4. a running sum inside each partition plus that offset is the row's global
   byte position, and its midpoint picks the shard.

Edge cases: a null text counts as no bytes and has checksum 0; null keys sort
first; repeated rows keep a slot each (equal rows are interchangeable); an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

LAW = "bytes"


def assign_shards(rows: DataFrame, order: list[str], size: str, shards: int = 16) -> DataFrame:
    """``rows`` plus ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in it).

    ``order`` names the columns of the global order and ``size`` the bytes of a
    row.  Shards are contiguous in that order; the bytes of two shards differ by
    little more than one row.  ``rows`` should be narrow: all of it is shuffled.
    """
    tie = [F.col(c) for c in order]
    spread = rows.repartitionByRange(*tie).sortWithinPartitions(*tie)
    pinned = staged(spread.withColumn("_part", F.spark_partition_id()), "shard-order")

    totals = pinned.groupBy("_part").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy("_part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(everything).alias("_bytes_all"),
    )
    # One row for each range partition: bounded by the partition count, whatever the data.
    within = W.partitionBy("_part").orderBy(*tie)
    placed = (
        pinned.join(F.broadcast(offsets), "_part")
        .withColumn("_start", F.col("_bytes_before") + F.sum(size).over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col(size))
        .withColumn("_index", F.col("_rows_before") + F.row_number().over(within) - 1)
        .withColumn("shard", F.expr(f"CAST(least((2 * _start + {size}) * {shards} div (2 * _bytes_all), {shards - 1}) AS INT)"))
    )
    # The first global index of each shard: as many rows as shards.
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    kept = [F.col(c) for c in rows.columns]
    return placed.join(F.broadcast(first), "shard").select(*kept, "shard", (F.col("_index") - F.col("_first")).alias("slot"))


def op1_sharding(spark, sf_dir) -> DataFrame:
    """All documents in 16 shards of near-equal bytes, contiguous by doc_id."""
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("bigint").alias("text_crc32"),
    )
    sharded = assign_shards(staged(narrow, "shard-sizes"), ["doc_id", "text_crc32", "size"], "size", 16)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
