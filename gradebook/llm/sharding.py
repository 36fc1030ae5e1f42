"""Contiguous shards of nearly equal bytes, from global prefix sums.

Rows are put in one global order (id, size, checksum) by range partitioning.  Each partition
reports one total (bytes, rows); the running sums of those totals are the offsets at which the
partitions' own running sums start.  A row goes to the shard in whose equal byte range its middle
byte falls, so shards are contiguous in the order and differ by less than one row's size.

Only (id, size, checksum) is shuffled, never a text.  The ordered rows are written once to the
shared folder, so both passes see the same partitions.  A last tie-breaker by input row deals equal
rows (a hot group of copies) over partitions; equal rows are interchangeable in the result.

Defined results: a null text has no bytes (size 16) and checksum 0; null ids come first; repeated
rows each get a slot of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook.llm.common import stored

ROW_OVERHEAD = 16


def byte_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Per row: id, size, text_crc32, shard (0 to ``n_shards`` - 1) and slot (gapless from 0 in its shard)."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("_size"),
                       F.crc32(raw).alias("_crc"), F.monotonically_increasing_id().alias("_tie"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "_id", "_size", "_crc", "_tie").withColumn("_part", F.spark_partition_id())
    rows = stored(rows, "byte-shards")

    totals = rows.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    # One row per range partition: n rows by construction, so a single window task and a broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
                            F.sum("_bytes").over(everything).alias("_all_bytes"))
    inside = Window.partitionBy("_part").orderBy("_id", "_size", "_crc", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("_bytes_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
              .withColumn("_rows_in", F.count("*").over(inside))
              .join(F.broadcast(offsets), "_part"))
    middle = (F.col("_bytes_before") + F.col("_bytes_in")) * 2 + F.col("_size")
    placed = placed.select(
        "_id", "_size", "_crc", (F.col("_rows_before") + F.col("_rows_in")).alias("_row"),
        F.least(F.lit(n_shards - 1), F.floor(
            middle.cast("decimal(38,0)") * n_shards / (F.col("_all_bytes") * 2))).cast("int").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))   # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))
