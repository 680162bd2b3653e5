"""Contiguous, byte-balanced shards from global prefix sums (law ``bytes``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import pinned

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut all rows, in id order, into ``n_shards`` contiguous shards of near equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus ``OVERHEAD``. Rows are
    range-partitioned by id on narrow columns only (id, size, checksum: the text is not
    moved) and written once. Each partition then sums its own sizes; the table of
    per-partition totals (one row per partition) gives every partition its offset, and
    offset plus local running sum is the global prefix sum. A row belongs to the shard
    that holds its middle byte, so a shard's size differs from total / n_shards by at
    most the largest row.

    Ids may be null (first) or repeated; ties are ordered by size and checksum, and rows
    equal in all three are interchangeable. An empty table gives no rows. More shards than
    rows leave shards empty. Returns id, size, text_crc32, law, shard, slot (gapless from
    0 in each shard), grown_shard (null: this law moves rows when a shard is added).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("crc"))
    order = ["id", "size", "crc"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # sampled range bounds: fix the partition of every row once, before it is read twice
    ranged = pinned(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    totals = (ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
              .select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                      F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
                      F.sum("bytes").over(everything).alias("total")))
    local = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (ranged.withColumns({"to": F.sum("size").over(local), "at": F.row_number().over(local)})
              .join(F.broadcast(totals), "part")  # one row per partition
              .withColumns({"to": F.col("to") + F.col("bytes_before"), "at": F.col("at") + F.col("rows_before")}))
    # middle of the row as a share of the total, in exact integers
    middle = (2 * F.col("to") - F.col("size")).cast("decimal(24,0)")
    shard = F.floor(middle * F.lit(n_shards).cast("decimal(10,0)") / (2 * F.col("total")).cast("decimal(24,0)")).cast("int")
    cut = pinned(summed.select(*order, "at", F.least(shard, F.lit(n_shards - 1)).alias("shard")))
    firsts = cut.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
