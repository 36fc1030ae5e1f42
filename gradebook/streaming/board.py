"""Windowed leaderboard over the judgment log.

The same transformation runs on a batch DataFrame and on a streaming one:

    judgments (rows of the judgment log)
      -> parse rating (V1), event time = timestamp_seconds(tstamp)
      -> withWatermark(event_time)           rows older than the previous micro-batch's
                                             watermark are dropped (and counted)
      -> groupBy(tumbling window, model)      count / sum / mean score

On a stream the state is bounded by the watermark.  In ``append`` mode a finished window is written once, never
revised, to a Parquet table; in ``complete`` mode the board of all windows is written anew with every batch, as the
newest version of a live board.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradebook.functions.extract import rating
from gradebook.session import delete_path
from gradebook.sources import judgment_log as J


def scored_events(judgments: DataFrame) -> DataFrame:
    """Parse the rating and derive the event time from the epoch-seconds tstamp; key columns go along where there are any."""
    keys = [c for c in (*J.KEYS[J.SINGLE], "commit") if c in judgments.columns and c not in ("question_id", "model")]
    return judgments.select(
        "question_id", "model", *keys, rating("judgment").alias("score"),
        F.timestamp_seconds(F.col("tstamp")).alias("event_time"))


def windowed_board(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours",
                   dedupe_keys: list[str] | None = None) -> DataFrame:
    """Per tumbling window and model: judgment count, score sum and mean.

    ``dedupe_keys`` drops repeated judgments of the same key seen within the
    watermark (the first one is kept).
    """
    e = events.withWatermark("event_time", watermark)
    if dedupe_keys:
        e = e.dropDuplicatesWithinWatermark(dedupe_keys)
    g = e.groupBy(F.window("event_time", window).alias("w"), "model").agg(
        F.count("*").alias("n"), F.sum("score").alias("score_sum"), F.avg("score").alias("score_avg"))
    # Window starts as epoch seconds: the same value whatever the session time zone.
    return g.select(F.unix_seconds("w.start").alias("window_start"), "model", "n", "score_sum", "score_avg")


def _live(sink: str, keep: int = 2):
    def put(board: DataFrame, batch_id: int) -> None:
        path = lambda b: f"{sink.rstrip('/')}/v={b:012d}"
        board.write.mode("overwrite").parquet(path(batch_id))
        if batch_id >= keep:
            delete_path(board.sparkSession, path(batch_id - keep))

    return put


def read_live(spark: SparkSession, sink: str) -> DataFrame:
    """The newest version of a live board."""
    rows = spark.read.option("basePath", sink).parquet(sink)
    return rows.where(F.col("v") == rows.agg(F.max("v")).first()[0]).drop("v")


def start_board(spark: SparkSession, log: str, sink: str, checkpoint: str, window: str = "1 hour",
                watermark: str = "2 hours", output_mode: str = "append", max_files_per_trigger: int | None = None,
                query_name: str | None = None, dedupe_keys: list[str] | None = None) -> StreamingQuery:
    """Start the streaming board over the single judgments of the judgment log ``log``.

    ``sink`` is a path (``append``: a Parquet table of finished windows; ``complete``: a live board, see ``read_live``) or
    ``"memory"`` for tests.  The checkpoint must live on shared storage so a restarted driver resumes.
    """
    if sink != "memory" and output_mode not in ("append", "complete"):
        raise ValueError("a stored board is written in append or complete mode")
    events = scored_events(J.read_stream(spark, log, J.SINGLE, max_files_per_trigger))
    w = windowed_board(events, window, watermark, dedupe_keys).writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
    if sink == "memory":
        w = w.format("memory").queryName(query_name or "stream_board")
    elif output_mode == "complete":
        w = w.foreachBatch(_live(sink))
    else:
        w = w.format("parquet").option("path", sink)
    return w.start()


def dropped_late_rows_from(progress) -> int:
    """Rows dropped by the watermark in one progress report."""
    p = progress or {}
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in p.get("stateOperators", []))


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows dropped by the watermark over the progress reports the query keeps."""
    return sum(dropped_late_rows_from(p) for p in query.recentProgress)
