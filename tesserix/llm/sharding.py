"""Contiguous byte-balanced shards from global prefix sums. DataFrame functions only.

The rows are range-partitioned on the id; each partition reports one total; the
exclusive prefix over those few totals gives every partition its global start; a running
sum inside the partition gives every row its global byte position. A row belongs to the
shard in whose equal target interval the middle of its bytes lies, so each cut is off its
target by at most half a row.

Defined results: a null or empty text has size 1; rows that repeat an id are separate rows,
in the order of checksum and size; a null id sorts first; an empty table gives no rows;
extra columns are ignored, whatever their names. A hot id spreads over partitions, as
the range key ends in a row number. Nothing here is collected: the two broadcast tables have one
row per range partition and one row per shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserix.llm.common import cut, salted


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards are runs of rows in id order, sizes near equal."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    body = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_tie")]
    placed = cut(sized.repartitionByRange(salted(docs), *order).withColumn("_part", F.spark_partition_id()))

    totals = placed.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_start"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_start"),
        F.sum("_bytes").over(everything).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(F.broadcast(starts), "_part").select(
        "doc_id", "size", "text_crc32",
        (F.col("_row_start") + F.row_number().over(inside) - 1).alias("_row"),
        # The middle, doubled to stay in whole numbers; decimals, as bytes times shards can pass 2^63.
        (2 * (F.col("_byte_start") + F.sum("size").over(running)) - F.col("size")).cast("decimal(25,0)").alias("_mid2"),
        (2 * F.col("_total")).cast("decimal(25,0)").alias("_total2"),
    )
    sharded = ranked.withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(_mid2 * {int(n_shards)}) div _total2").cast("int")))
    firsts = sharded.groupBy("shard").agg(F.min("_row").alias("_first"))
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot"))
