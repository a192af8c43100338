"""Contiguous byte-balanced shards from global prefix sums, DataFrame functions only.

Rows are range-partitioned by id; per-partition totals (one row per partition) give
each partition its global offset, and a window inside each partition does the rest.
No task sees more than one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bytes that a row counts besides its text.
ROW_BYTES = 16


def balanced_shards(docs: DataFrame, shards: int = 40, partitions: int | None = None, row_bytes: int = ROW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) under the law ``bytes``.

    In id order (ties by size and checksum) a row belongs to the shard that holds the
    middle of its bytes, when the sum of all sizes is cut at equal targets; ``slot`` counts a
    shard's rows from 0 without gaps. A null text has no bytes and no checksum but
    0; rows with a null id come first; repeated rows each have a place of their own.
    A row larger than a target can leave a shard empty. An empty table gives none.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + row_bytes).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: the ranges come from a sample, and both uses below must see the same.
    ranged = materialize(sized.repartitionByRange(count, "doc_id", "size", "text_crc32").withColumn("part", F.spark_partition_id()), "ranges")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_0"), F.sum("bytes").over(everything).alias("total"))

    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("row_0") + F.col("nth") - 1).alias("at"),
            F.least(F.lit(shards - 1).cast("long"), F.expr(f"((byte_0 + upto) * 2 - size) * {shards} div (total * 2)")).cast("int").alias("shard"),
        )
    )
    placed = materialize(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
