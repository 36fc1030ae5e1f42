"""The judgment log (S9, N3, N4, N7): one table from judging runs to boards, token totals and streams.

Layout: ``<root>/mode=single|pair/bench=/judge_model=/iid=/commit=/*.parquet``.  What names a file in a
file-per-run layout is a partition here, so choosing a judge, a bench or a run tag prunes folders, and a board reads
the winners without the texts.

Every append is one commit.  Its rows go into folders of their own; when they are all written, the commit is
entered under ``<root>/_commits``.  Readers take entered commits only, so a run that died half way is not read, and an
append that is repeated under the same commit id is not written, or read, twice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.operators.batchfn import finished
from gradebook.session import read_parquet_if_exists

SINGLE, PAIR = "single", "pair"
PARTITIONS = ["mode", "bench", "judge_model", "iid", "commit"]
FIELDS = ("question_id long, model string, model_1 string, model_2 string, judge_prompt string, turn int, user_prompt string, "
          "judgment string, score double, g1_user_prompt string, g1_judgment string, g2_user_prompt string, g2_judgment string, "
          "g1_winner string, g2_winner string, winner string, m1_score double, m2_score double, error string, g1_error string, "
          "g2_error string, tstamp double")
SCHEMA = FIELDS + "".join(f", {p} string" for p in PARTITIONS)
#: What tells one judgment of a mode from another; a later row of the same key replaces an earlier one.
KEYS = {SINGLE: ["bench", "iid", "judge_model", "judge_prompt", "question_id", "model", "turn"],
        PAIR: ["bench", "iid", "judge_model", "judge_prompt", "question_id", "model_1", "model_2", "turn"]}
#: A partition without a value.
NONE = "none"


def _mode(mode: str) -> str:
    if mode not in KEYS:
        raise ValueError(f"a judgment log holds modes {sorted(KEYS)}, not {mode!r}")
    return mode


def _commits(spark: SparkSession, root: str) -> DataFrame | None:
    return read_parquet_if_exists(spark, f"{root.rstrip('/')}/_commits")


def is_committed(spark: SparkSession, root: str, commit: str) -> bool:
    done = _commits(spark, root)
    return done is not None and not done.where(F.col("commit") == commit).isEmpty()


def append(judgments: DataFrame, root: str, mode: str, commit: str | None = None, **partitions: str) -> str:
    """N3/N4 + N7: append judgments as one commit; returns its id.

    ``partitions`` (bench, judge_model, iid) are constants; otherwise they are columns, or ``none``.  A column ``judge`` of
    (judge model, prompt name) is taken apart.  An id that is already committed makes this a no-op.
    """
    spark, commit = judgments.sparkSession, commit or uuid.uuid4().hex
    unknown = set(partitions) - {"bench", "judge_model", "iid"}
    if unknown:
        raise ValueError(f"not a partition of the log: {sorted(unknown)}")
    if is_committed(spark, root, commit):
        return commit
    given = {"mode": F.lit(_mode(mode)), "commit": F.lit(commit), **{k: F.lit(v) for k, v in partitions.items()}}
    if "judge" in judgments.columns:
        for i, c in enumerate(("judge_model", "judge_prompt")):
            given.setdefault(c, F.coalesce(F.col(c), F.get("judge", i)) if c in judgments.columns else F.get("judge", i))
    def column(spec: str) -> Column:
        name, kind = spec.split()
        c = given.get(name, F.col(name) if name in judgments.columns else F.lit(None)).cast(kind)
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(NONE)).alias(name) if name in PARTITIONS else c.alias(name)

    rows = judgments.select(*[column(s) for s in SCHEMA.split(", ")])
    # Overwriting its own folders only: what a failed try of this commit left there goes.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(root)
    spark.createDataFrame([(commit,)], "commit string").select("commit", F.current_timestamp().alias("at")) \
        .coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/_commits")
    return commit


def read(spark: SparkSession, root: str, mode: str, latest: bool = False, **filters: str) -> DataFrame:
    """The committed judgments of a mode, filtered by partition (bench, judge_model, iid).

    ``latest`` gives one row per judgment: the last success, else the last error.  A root without commits is an error.
    """
    unknown = set(filters) - set(PARTITIONS)
    if unknown:
        raise ValueError(f"not a partition of the log: {sorted(unknown)}")
    commits = _commits(spark, root)
    if commits is None:
        raise FileNotFoundError(f"no committed judgments under {root}")
    rows = spark.read.schema(SCHEMA).parquet(root).where(F.col("mode") == _mode(mode))
    for k, v in filters.items():
        rows = rows.where(F.col(k) == v)
    rows = rows.join(commits.select("commit").distinct(), "commit", "left_semi")
    return finished(rows, KEYS[mode]) if latest else rows


def stored(spark: SparkSession, root: str, mode: str, **filters: str) -> DataFrame | None:
    """As ``read``, or None before the first commit (a first run has nothing to resume)."""
    return None if _commits(spark, root) is None else read(spark, root, mode, **filters)


def read_stream(spark: SparkSession, root: str, mode: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream of appended rows.  A commit that failed and was repeated shows its rows twice, with
    equal commit id and key: keep-last consumers are not affected."""
    reader = spark.readStream.schema(SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(root).where(F.col("mode") == _mode(mode))


def import_jsonl(spark: SparkSession, path: str, root: str, mode: str, commit: str | None = None, **partitions: str) -> str:
    """Append a JSON-lines judgment file (one row per judgment, ``judge`` = [model, prompt]) to the log; returns the commit."""
    rows = spark.read.schema(FIELDS + ", judge array<string>").json(path)
    if mode == SINGLE:
        rows = rows.where(F.col("model").isNotNull())
    return append(rows, root, mode, commit, **partitions)
