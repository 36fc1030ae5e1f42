"""Table conversion and projection operators.

Dense file-order numbering (C3), row slices (S4) and chunking (R6) need a global
position.  A global ``row_number()`` window runs in a single task, so positions
are computed in two passes instead: rows are put into ordered buckets, numbered
inside each bucket, and shifted by per-bucket offsets from a tiny count table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook import fixed
from gradebook.functions.text import concat_nonnull, cut_at


def _offsets(counts: DataFrame, key: str) -> DataFrame:
    # Running count of the earlier buckets; one row per bucket (bounded by n).
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))


def with_position(df: DataFrame, order_col: str, out: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add a dense 0-based position in ``order_col`` order (order_col unique; nulls first).

    The input is computed once: range-partitioned, numbered within each partition and written
    to the shared folder.  Each partition is then shifted by the counts of the earlier ones (a
    table of one row per partition, broadcast).  Counts and numbers come from the same stored
    partitions, so they agree whatever bounds the range partitioning sampled.
    """
    from gradebook.session import materialize

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order_col).asc_nulls_first()
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialize(ranged, f"positions-{uuid.uuid4().hex}")
    offsets = _offsets(ranged.groupBy("_pid").agg(F.count("*").alias("_n")), "_pid")
    out_df = ranged.join(F.broadcast(offsets), "_pid")
    return out_df.select(*df.columns, (F.col("_off") + F.col("_local")).cast("long").alias(out))


def python_slice(df: DataFrame, order_col: str, begin: int | None, end: int | None) -> DataFrame:
    """Rows ``[begin:end]`` of the ``order_col`` order with Python slice rules
    (None bounds, negative indexes counted from the end, empty when crossed)."""
    pos = with_position(df, order_col, "_pos")
    total = df.count() if ((begin or 0) < 0 or (end is not None and end < 0)) else None

    def norm(i: int | None, default: int) -> int:
        if i is None:
            return default
        if i < 0:
            return max(0, total + i)
        return i

    lo = norm(begin, 0)
    cond = F.col("_pos") >= lo
    if end is not None:
        cond = cond & (F.col("_pos") < norm(end, 0))
    return pos.filter(cond).drop("_pos")


def merged_prompt(instruction: Column | str, inp: Column | str) -> Column:
    """Instruction + input, with missing cells (and the text ``nan``) skipped."""
    return concat_nonnull(instruction, inp)


def convert_raw_qa(raw: DataFrame, answer_id: str = "hash") -> DataFrame:
    """C1-C4 + N1 input: raw QA rows -> questions and reference answers in one row.

    Rows whose merged prompt is empty are dropped *before* ids are assigned; ids
    are dense, 1-based, in ``seq`` (file) order.  ``answer_id`` is a content hash
    (deterministic) or ``uuid`` (random, as the reference's short ids).
    """
    r = raw.select("*", merged_prompt("instruction", "input").alias("_q")).filter(F.length("_q") > 0)
    r = with_position(r, "seq", "_pos")
    qid = (F.col("_pos") + 1).cast("long")
    aid = F.sha2(qid.cast("string"), 256) if answer_id == "hash" else F.expr("uuid()")
    return r.select(
        qid.alias("question_id"),
        F.lit("generic").alias("category"),
        F.col("ops_field"), F.col("task_type"),
        F.array("_q").alias("question"),
        aid.alias("answer_id"),
        F.lit("expert").alias("model_id"),
        F.array(F.col("output")).alias("model_answer"),
        F.lit(0.0).alias("tstamp"),
    )


def temperature(category: Column | str) -> Column:
    """Sampling temperature by category (default 0.7)."""
    m = F.create_map(*[x for k, v in fixed.TEMPERATURE_CONFIG.items() for x in (F.lit(k), F.lit(float(v)))])
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(F.try_element_at(m, c), F.lit(fixed.DEFAULT_TEMPERATURE))


def do_sample(temp: Column) -> Column:
    """Sampling is on unless the temperature is (near) zero."""
    return temp >= F.lit(fixed.GREEDY_BELOW)


def stop_cut(text: Column | str, stop: str) -> Column:
    """C6 (D8 fixed): cut at the stop string only when it occurs, then strip."""
    return cut_at(text, stop)


def turn_rows(questions: DataFrame) -> DataFrame:
    """One row per question turn (1-based turn number)."""
    return questions.select("question_id", F.posexplode("question").alias("p", "text")).select(
        "question_id", (F.col("p") + 1).cast("int").alias("turn"), "text")


def chunk_assign(df: DataFrame, order_col: str, n_workers: int) -> DataFrame:
    """Chunks of ``len // n_workers`` rows in order; the remainder forms an
    extra chunk.  Fails when there are more workers than rows."""
    total = df.count()
    size = total // n_workers
    if size == 0:
        raise ValueError(f"{n_workers} chunks for {total} rows")
    pos = with_position(df, order_col, "_pos")
    return pos.withColumn("chunk", (F.col("_pos") / F.lit(size)).cast("long")).drop("_pos")
