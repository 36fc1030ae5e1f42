"""Session construction and shared-storage helpers.

Library functions never create a session; they take DataFrames.  ``build_session``
is for tests, the bench and command-line use on a single machine.  On a cluster the
caller's session is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are session-level and overridable.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only below this size; AQE re-plans with runtime sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Target post-shuffle partition size; AQE coalesces small ones and splits skewed ones.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
}


def shuffle_partitions_for(input_bytes: int, total_cores: int, target_bytes: int = 128 * 1024 * 1024) -> int:
    """Initial ``spark.sql.shuffle.partitions`` for a job over ``input_bytes``:
    enough for ~``target_bytes`` per partition and at least two waves of tasks.
    AQE coalesces down from this number, never up, so err on the high side
    (100 TB at 128 MB gives ~800k; with 1000 executors x 8 cores, >= 16k)."""
    return max(2 * total_cores, -(-input_bytes // target_bytes))


def build_session(
    master: str | None = None,
    shuffle_partitions: int = 8,
    app_name: str = "gradebook",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and the bench (UI off, AQE on, UTC)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**SCALE_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-split input (for example one file with a single row group,
    which Spark reads in one task) round-robin over the available cores.

    An input already read in at least ``min_partitions`` splits (default: the
    cluster's default parallelism) is returned untouched, so on large inputs no
    shuffle is added.  Filters and column pruning still reach the scan.
    """
    try:
        n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= n:
            return df
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: no RDD view, leave the input as is
        return df
    return df.repartition(n)


def single_machine(spark: SparkSession) -> bool:
    """Whether the driver runs every task itself (``local`` or ``local[n]``)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession, create_local_if_unset: bool = False) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the operator (a shared file system).  Only
    tests and local runs may ask for a private temporary folder.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        if not sc.getCheckpointDir():
            # Set as a session conf at run time: DataFrame.checkpoint() reads the
            # SparkContext's folder, so align the two.
            sc.setCheckpointDir(path)
        return path
    if not create_local_if_unset:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(for example an object-store or HDFS path) before running jobs "
            "that materialise intermediate tables"
        )
    # spark.checkpoint.dir is a static setting; only the SparkContext folder can
    # be set at run time (tests and local runs only).
    path = tempfile.mkdtemp(prefix="gradebook-ckpt-")
    sc.setCheckpointDir(path)
    return path


def read_parquet_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """Read a Parquet table, or ``None`` when nothing was written there yet.

    Only a missing path means "first run"; any other read error is raised, so a
    transient failure never makes a resumable job redo (and duplicate) its work.
    """
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", lambda: None)
        cls = cond() or ""
        if cls == "PATH_NOT_FOUND" or "Path does not exist" in str(e):
            return None
        raise


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies on; nothing happens where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Used to cut lineage after expensive steps (model calls) so that a lost
    executor or a retried task never repeats them.
    """
    spark = spark or df.sparkSession
    base = checkpoint_dir(spark, create_local_if_unset=single_machine(spark))
    path = f"{base.rstrip('/')}/tables/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
