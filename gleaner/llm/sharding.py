"""Contiguous shards of equal bytes: global prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import columns


def byte_shards(documents: DataFrame, shards: int = 16, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its shard and its slot there; shards are contiguous in the order of the id.

    Size is the UTF-8 bytes of the text (null: none) plus 1. A row belongs to the shard
    in whose equal share of all bytes its middle lies, so a shard differs from its share
    by less than one row at each end. Rows are ordered by id (null first), then CRC and
    size; equal rows are interchangeable. An empty table gives no rows.

    Only (id, size, CRC) leave the scan. Range partitions are bounded also for one
    repeated id, as the row's number in the scan ends the sort key. The placed rows are
    checkpointed, because the ranges are sampled and a rerun could cut them elsewhere.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = columns(documents, doc_id=id, text=text).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("read"))
    rows = cut_lineage(rows)
    placed = rows.repartitionByRange("doc_id", "text_crc32", "size", "read").sortWithinPartitions("doc_id", "text_crc32", "size", "read")
    placed = cut_lineage(placed.drop("read").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("at")
    numbered = placed.select(
        "doc_id", "size", "text_crc32", "part",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.row_number().over(inside) - 1).cast("long").alias("_row"),
    ).join(F.broadcast(starts), "part")  # one row for each partition
    middle = 2 * (F.col("bytes_before") + F.col("_start")) + F.col("size")
    cut = numbered.select(
        "doc_id", "size", "text_crc32",
        F.floor(middle * shards / (2 * F.col("all_bytes"))).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("_row")).alias("_row"),
    )
    firsts = cut.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cut.join(F.broadcast(firsts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
