"""Balanced contiguous shards from global byte-size prefix sums.

Rows (without texts) are dealt into id ranges once and written to the checkpoint, so
that every later step sees the same ranges. Each range's totals are one row; their
running sums (a window over ranges, not rows) give each range its offset, and a
window inside a range gives each row its global prefix. A row goes to the shard in
which the middle of its bytes falls, so no shard is further from the equal target
than one document.

Defined results: null text has no bytes and counts its 8 header bytes only; ids may
repeat or be null (null first; equal ids are ordered by size and checksum); an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import text_or_empty

HEADER_BYTES = 8


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                   ranges: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, prefix (bytes before the row), shard, slot``."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    body = text_or_empty(F.col(text_col))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (F.octet_length(body) + F.lit(HEADER_BYTES)).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("copy")).checkpoint()
    order = ["doc_id", "size", "text_crc32", "copy"]  # rows that are alike in all else need not share a range
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                            F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (dealt.withColumn("in_part", F.coalesce(F.sum("size").over(running), F.lit(0)))
                   .withColumn("row_in_part", F.row_number().over(inside) - 1)
                   .join(offsets, "part")
                   .withColumn("prefix", F.col("bytes_before") + F.col("in_part"))
                   .withColumn("row", F.col("rows_before") + F.col("row_in_part"))
                   .withColumn("shard", F.expr(f"cast(((2 * prefix + size) * {int(n_shards)}) div (2 * total) as int)"))
                   .select("doc_id", "size", "text_crc32", "prefix", "row", "shard").checkpoint())
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return (placed.join(F.broadcast(first), "shard")  # one row per shard
                  .withColumn("slot", (F.col("row") - F.col("first_row")).cast("long"))
                  .select("doc_id", "size", "text_crc32", "prefix", "shard", "slot"))
