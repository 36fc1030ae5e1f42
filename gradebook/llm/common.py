"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook.session import checkpoint_dir, single_machine

#: What separates words: space and \\t \\n \\v \\f \\r (as a Java and RE2 character class).
SPACE = r"[\x20\x09-\x0D]"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words (runs without white space) of a text; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def without_space(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _SPACE_CHARS, "")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of the cluster (``spark.checkpoint.dir``); where that is
    unset, a cluster session is refused and a single-machine one gets a folder of its own."""
    base = checkpoint_dir(spark, create_local_if_unset=single_machine(spark))
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it back: cuts the lineage, so
    that a lost executor repeats a read and not the work, and fixes the rows for several readers."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key of more than one in so many rows is hot; there are fewer hot keys than this.
HOT = 1000


def join_hot(big: DataFrame, small: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per value of ``key`` (null is a value) and in
    ``count`` the number of its rows in ``big``.  The hot keys, fewer than ``HOT`` rows, are broadcast, so
    that no task gathers one of them; the others are joined by shuffle.  Both tables are read twice."""
    total = small.agg(F.coalesce(F.sum(count), F.lit(0)).cast("double")).first()[0]
    hot, cold = small.where(F.col(count) * HOT > F.lit(total)), small.where(F.col(count) * HOT <= F.lit(total))
    names = [c for c in big.columns if c != key] + [c for c in small.columns if c not in (key, count)]

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed(key, "__key")
        out = left.join(right, left[key].eqNullSafe(right["__key"]), how)
        return out.select(key, *names) if how == "inner" else out

    rest = joined(big, F.broadcast(hot.select(key)), "left_anti")
    return joined(big, F.broadcast(hot)).union(joined(rest, cold))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 0 within ``group`` by ``order`` (no ties): one stored range partitioning,
    numbers inside each partition, shifted by the counts of the partitions before it.  No task holds a whole group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(n, group, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    totals = rows.groupBy("__part", group).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", group).orderBy(*order)
    return (rows.withColumn("__at", F.row_number().over(inside) - 1).join(offsets, ["__part", group])
            .withColumn("rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before"))


#: Components whose floors reach beyond this would not fit the integer results.
COMPONENT = 1 << 27


def floored(table: DataFrame, vec_col: str, scale: int = 256, name: str = "vec") -> DataFrame:
    """``table`` with ``name``: array<long> of floor(scale * component).  Rows whose vector is null or holds null or
    non-finite components, or has not the most frequent length (of several, the smallest), go; a component
    beyond ``COMPONENT`` is an error."""
    x = F.col(vec_col).cast("array<double>")
    rows = table.where(F.col(vec_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    size = rows.groupBy(F.size(vec_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = F.transform(x, lambda v: F.when(F.abs(v) < COMPONENT / scale, F.floor(v * float(scale))).otherwise(
        F.raise_error(F.concat(F.lit("component too large: "), v.cast("string"))).cast("long")))
    return rows.where(F.size(vec_col) == (size["n"] if size else -1)).withColumn(name, whole)
