"""Exact boards over the judgment log as a stream (R8): keep-last per judgment, retractions, no rescan.

Judgment logs are keep-*last*: a judgment that is made again replaces the earlier verdict.  The state store holds the latest
judgment of every key (``judgment_log.KEYS``).  When a newer one arrives, the old one goes out with sign -1 and the new
one with sign +1, so a board is a running sum of signed rows:

* single mode: judgments and score sum per model;
* pair mode: wins, losses and ties per model (A6), the old outcome of a re-judged game subtracted.

Work and writes of a micro-batch follow the batch: the state store writes the changed keys, and the board, one row per
bench, judge, run tag and model, is written anew as a small version.  ``retention`` forgets keys: once the watermark has passed the
last judgment of a key by so much, its contribution to the board is final.  Later rows of the key are late then and are dropped
by the watermark.

"Newer" is the greater (tstamp, commit, content): the result does not depend on how the log is cut into batches or
on rows that are read twice.  A replayed batch reads the version before it and overwrites its own, so restarts are idempotent.
Checkpoint and root belong on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradebook.operators.boards import pair_outcomes
from gradebook.operators.keeplast import keep_last
from gradebook.session import delete_path, read_parquet_if_exists
from gradebook.sources import judgment_log as J

RUN = ["bench", "judge_model", "iid"]
#: What a board needs of a judgment, by mode.
CONTENT = {J.SINGLE: "score double", J.PAIR: "g1_winner string, g2_winner string"}
_ORDER = "t double, c string, v string"


def _versioned(judgments: DataFrame, mode: str) -> DataFrame:
    """Keys, and (t, c, v): when, in which commit, and what as JSON."""
    names = [c.split()[0] for c in CONTENT[mode].split(", ")]
    return judgments.select(*J.KEYS[mode], F.coalesce("tstamp", F.lit(float("-inf"))).alias("t"), F.coalesce("commit", F.lit("")).alias("c"),
                            F.to_json(F.struct(*names)).alias("v"))


def _content(rows: DataFrame, mode: str) -> DataFrame:
    return rows.withColumn("v", F.from_json("v", CONTENT[mode])).select("*", "v.*").drop("v")


def latest(judgments: DataFrame, mode: str) -> DataFrame:
    """Batch form: the latest judgment of every key, with its content."""
    rows = _versioned(judgments, mode).withColumn("seq", F.struct("t", "c", "v"))
    return _content(keep_last(rows, J.KEYS[mode]).select(*J.KEYS[mode], "v"), mode)


def changes(judgments: DataFrame, mode: str, retention: str | None = None) -> DataFrame:
    """Streaming form: signed rows (keys, content, sign) that turn the latest judgments before a batch into those after it."""
    keys = J.KEYS[mode]
    rows = _versioned(judgments, mode)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    wait = None
    if retention is not None:
        start = "TIMESTAMP '2000-01-01 00:00:00'"
        wait = 1000 * rows.sparkSession.sql(f"SELECT unix_seconds({start} + INTERVAL {retention}) - unix_seconds({start}) AS x").first().x
        rows = rows.withColumn("at", F.timestamp_seconds(F.greatest("t", F.lit(0.0)))).withWatermark("at", retention)

    def step(key: tuple, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        old = state.get if state.exists else None
        new = old
        for frame in frames:
            for row in zip(frame["t"], frame["c"], frame["v"], strict=True):
                if new is None or row > new:
                    new = row
        if new is not None and (old is None or new[2] != old[2]):
            signed = ([] if old is None else [(old[2], -1)]) + [(new[2], 1)]
            yield pd.DataFrame([(*key, v, s) for v, s in signed], columns=[*keys, "v", "sign"])
        if new is not None and new != old:
            state.update((float(new[0]), new[1], new[2]))
        if wait is not None and new is not None:
            state.setTimeoutTimestamp(max(int(max(new[0], 0.0) * 1000) + wait, state.getCurrentWatermarkMs() + 1))

    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "v string", "sign int"])
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.EventTimeTimeout
    return _content(rows.groupBy(*keys).applyInPandasWithState(step, out, _ORDER, "append", timeout), mode)


def _sums(mode: str) -> list[str]:
    return ["n", "score_sum"] if mode == J.SINGLE else ["win", "loss", "tie"]


def board_sums(rows: DataFrame, mode: str, sign: Column | None = None) -> DataFrame:
    """The additive columns of a board per bench, judge, run tag and model, of latest judgments or of signed changes."""
    rows = rows.withColumn("_sign", F.lit(1) if sign is None else sign)
    if mode == J.SINGLE:
        one = rows.select(*RUN, "model", F.col("_sign").cast("long").alias("n"), (F.col("score") * F.col("_sign")).alias("score_sum"))
    else:
        one = pair_outcomes(rows, keep=[*RUN, "_sign"]).select(*RUN, "model", *[(F.col(c) * F.col("_sign")).alias(c) for c in _sums(mode)])
    return one.groupBy(*RUN, "model").agg(*[F.sum(c).alias(c) for c in _sums(mode)])


def with_rates(sums: DataFrame, mode: str) -> DataFrame:
    """The board of additive columns: mean score, or win and loss rates; models without judgments are left out."""
    if mode == J.SINGLE:
        return sums.where("n > 0").withColumn("score", F.try_divide("score_sum", F.col("n").cast("double")))
    total = (F.col("win") + F.col("loss") + F.col("tie")).cast("double")
    return sums.where(total > 0).select("*", (F.col("win") / total).alias("win_rate"), (F.col("loss") / total).alias("loss_rate"))


def _version(root: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/board/v={batch_id:012d}"


def apply_changes(spark: SparkSession, batch: DataFrame, batch_id: int, root: str, mode: str, keep: int = 2) -> None:
    """Add a batch of signed changes to the board; versions before the last ``keep`` go."""
    delta = board_sums(batch, mode, F.col("sign"))
    before = read_parquet_if_exists(spark, _version(root, batch_id - 1)) if batch_id > 0 else None
    if before is not None:
        both = before.union(delta.select(*before.columns))
        delta = both.groupBy(*RUN, "model").agg(*[F.sum(c).alias(c) for c in _sums(mode)])
    delta.coalesce(1).write.mode("overwrite").parquet(_version(root, batch_id))      # a row per run and model
    if batch_id >= keep:
        delete_path(spark, _version(root, batch_id - keep))


def start_latest(spark: SparkSession, log: str, root: str, checkpoint: str, mode: str = J.SINGLE, retention: str | None = None,
                 max_files_per_trigger: int | None = None, on_batch: Callable | None = None) -> StreamingQuery:
    """Keep the board of a judgment log current under ``root``; ``retention`` is an interval such as ``30 days``."""
    signed = changes(J.read_stream(spark, log, mode, max_files_per_trigger), mode, retention)

    def put(batch: DataFrame, batch_id: int) -> None:
        apply_changes(spark, batch, batch_id, root, mode)
        if on_batch is not None:
            on_batch(batch_id)

    return signed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).start()


def read_board(spark: SparkSession, root: str, mode: str = J.SINGLE) -> DataFrame:
    """The newest version of the board."""
    rows = spark.read.option("basePath", f"{root.rstrip('/')}/board").parquet(f"{root.rstrip('/')}/board")
    newest = rows.agg(F.max("v")).first()[0]
    return with_rates(rows.where(F.col("v") == newest).drop("v"), mode)


def batch_board(judgments: DataFrame, mode: str) -> DataFrame:
    """The same board of a whole log at once."""
    return with_rates(board_sums(latest(judgments, mode), mode), mode)
