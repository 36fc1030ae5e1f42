"""Streaming boards over the judgment log: streaming equals batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gradebook.sources import judgment_log as J
from gradebook.streaming import board as SB
from gradebook.streaming import latest as L

SINGLE = ("question_id long, model string, judge_model string, judge_prompt string, turn int, user_prompt string, judgment string, score double, tstamp double")
PAIR = ("question_id long, model_1 string, model_2 string, judge_model string, judge_prompt string, turn int, g1_winner string, g2_winner string, "
        "g1_judgment string, tstamp double")


def single(rnd, t):
    n = rnd.randint(1, 9)
    return (rnd.randint(0, 12), rnd.choice("abc"), rnd.choice(["j", "k"]), "p", 1, "u", f"[[{n}]]", float(n), t)


def pair(rnd, t):
    w = ["model_1", "model_2", "tie", "error"]
    a, b = rnd.sample("abcd", 2)
    return (rnd.randint(0, 5), a, b, "j", "p", rnd.choice([1, 2]), rnd.choice(w), rnd.choice(w), "text", t)


def boards_equal(spark, log, root, mode):
    got, want = L.read_board(spark, root, mode), L.batch_board(J.read(spark, log, mode), mode)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect())
    assert key(got) == key(want)
    return want


@pytest.mark.parametrize("mode,make,schema", [(J.SINGLE, single, SINGLE), (J.PAIR, pair, PAIR)])
def test_board_of_the_stream_equals_the_batch(spark, tmpdir_, mode, make, schema):
    """Random commits: re-judged keys in and across batches, late and equal times, null times, empty commits, a restart."""
    rnd = random.Random(mode)
    log, root, ckpt = (os.path.join(tmpdir_, x) for x in ("log", "root", "ckpt"))

    def commit(n):
        rows = [make(rnd, None if rnd.random() < 0.1 else float(rnd.randint(0, 40))) for _ in range(n)]
        J.append(spark.createDataFrame(rows, schema).coalesce(1), log, mode, bench=rnd.choice(["x", "y"]))

    def run():
        q = L.start_latest(spark, log, root, ckpt, mode, max_files_per_trigger=2)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for n in (30, 0, 1, 25):
        commit(n)
    run()
    boards_equal(spark, log, root, mode)
    commit(40)
    run()                                                    # restarted from the checkpoint
    board = boards_equal(spark, log, root, mode)
    if mode == J.PAIR:                                       # A6: sums over models count every latest game twice
        from gradebook.operators.boards import win_board
        plain = {r.model: (r.win, r.loss, r.tie) for r in win_board(L.latest(J.read(spark, log, mode), mode)).collect()}
        sums = board.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("win", "loss", "tie")]).collect()
        assert {r.model: (r.win, r.loss, r.tie) for r in sums} == plain
    assert len([d for d in os.listdir(os.path.join(root, "board")) if d.startswith("v=")]) <= 2


def test_a_rejudged_game_takes_its_old_result_back(spark, tmpdir_):
    log, root, ckpt = (os.path.join(tmpdir_, x) for x in ("log", "root", "ckpt"))
    for t, w in ((1.0, "model_1"), (2.0, "model_2"), (1.5, "tie")):              # the third is older than the second
        J.append(spark.createDataFrame([(1, "a", "b", "j", "p", 1, w, w, "x", t)], PAIR), log, J.PAIR)
        q = L.start_latest(spark, log, root, ckpt, J.PAIR)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
    got = {r.model: (r.win, r.loss, r.tie) for r in L.read_board(spark, root, J.PAIR).collect()}
    assert got == {"a": (0, 1, 0), "b": (1, 0, 0)}


def test_a_replayed_batch_changes_nothing(spark, tmpdir_):
    signed = spark.createDataFrame([("x", "j", "none", "p", 1, "a", 1, 5.0, 1)],
                                   "bench string, judge_model string, iid string, judge_prompt string, question_id long, model string, turn int, score double, sign int")
    for b in (0, 1, 1, 2):
        L.apply_changes(spark, signed if b < 2 else signed.limit(0), b, tmpdir_, J.SINGLE)
    r = L.read_board(spark, tmpdir_).first()
    assert (r.n, r.score_sum) == (2, 10.0)


def test_state_writes_follow_the_batch(spark, tmpdir_):
    """A large first commit, then one row: what the state store writes for it is a small part of the first."""
    log, root, ckpt = (os.path.join(tmpdir_, x) for x in ("log", "root", "ckpt"))
    rows = spark.range(20_000).select(F.expr("id div 4").alias("question_id"), F.concat(F.lit("m"), F.col("id") % 4).alias("model"), F.lit("j").alias("judge_model"),
                                      F.lit("p").alias("judge_prompt"), F.lit(1).alias("turn"), F.lit("[[5]]").alias("judgment"), F.lit(5.0).alias("score"), F.lit(1.0).alias("tstamp"))
    J.append(rows, log, J.SINGLE)
    sizes = []
    for _ in range(2):
        seen = {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(ckpt, "state")) for f in fs}
        q = L.start_latest(spark, log, root, ckpt)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        new = {os.path.join(d, f) for d, _, fs in os.walk(os.path.join(ckpt, "state")) for f in fs if f.endswith(".delta")} - seen
        sizes.append(sum(os.path.getsize(f) for f in new))
        J.append(spark.createDataFrame([(1, "m1", "j", "p", 1, "u", "[[7]]", 7.0, 2.0)], SINGLE), log, J.SINGLE)
    assert sizes[1] < sizes[0] / 20
    assert {r.model: r.n for r in L.read_board(spark, root).collect()} == {f"m{i}": 5000 for i in range(4)}


def test_retention_forgets_keys(spark, tmpdir_):
    """Once the watermark is past a key, its state goes; its contribution stays."""
    log, root, ckpt = (os.path.join(tmpdir_, x) for x in ("log", "root", "ckpt"))
    progress = []

    def run():
        q = L.start_latest(spark, log, root, ckpt, J.SINGLE, retention="1 hour")
        try:
            q.processAllAvailable()
            progress.extend(q.recentProgress)
        finally:
            q.stop()

    for i, t in enumerate((1000.0, 1200.0, 50_000.0, 100_000.0)):
        J.append(spark.createDataFrame([(i, "a", "j", "p", 1, "u", "[[5]]", 5.0, t)], SINGLE), log, J.SINGLE)
        run()
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 4
    assert L.read_board(spark, root).first().n == 4


def _events(spark):
    from gradebook.plans import fixtures as fx
    return fx.judgment_stream_log(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("live", [False, True])
def test_windowed_board_of_the_stream_equals_the_batch(spark, tmpdir_, live):
    log, sink, ckpt = (os.path.join(tmpdir_, x) for x in ("log", "sink", "ckpt"))
    events = _events(spark).persist()
    cuts = events.selectExpr("percentile(tstamp, array(0.25, 0.5, 0.75)) AS x").first().x
    for lo, hi in zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True):        # in time order, as judge runs would
        J.append(events.where((F.col("tstamp") >= lo) & (F.col("tstamp") < hi)).coalesce(1), log, J.SINGLE)
    q = SB.start_board(spark, log, sink if live else "memory", ckpt, output_mode="complete", max_files_per_trigger=1, query_name="board_test")
    try:
        q.processAllAvailable()
        rows = SB.read_live(spark, sink) if live else spark.sql("SELECT * FROM board_test")
        streamed = sorted(map(tuple, rows.collect()))
        assert SB.dropped_late_rows(q) == 0
    finally:
        q.stop()
    assert streamed == sorted(map(tuple, SB.windowed_board(SB.scored_events(events)).collect())) and streamed
    with pytest.raises(ValueError, match="append or complete"):
        SB.start_board(spark, log, sink, ckpt, output_mode="update")


def test_late_rows_are_dropped_and_counted_and_repeats_are_not_counted(spark, tmpdir_):
    """Spark checks late events against the watermark of the previous micro-batch, so the late row
    arrives two batches after the watermark first moved."""
    log, ckpt = os.path.join(tmpdir_, "log"), os.path.join(tmpdir_, "ckpt")
    rows = [[(i, "a", "j", "p", 1, "u", "[[5]]", 5.0, 36000.0 + i) for i in range(3)] + [(0, "a", "j", "p", 1, "u", "[[5]]", 5.0, 36000.0)],   # 10:00, one twice
            [(9, "a", "j", "p", 1, "u", "[[7]]", 7.0, 36100.0)], [(8, "a", "j", "p", 1, "u", "[[9]]", 9.0, 60.0)]]                              # 00:01, late
    q = None
    try:
        for part in rows:
            J.append(spark.createDataFrame(part, SINGLE).coalesce(1), log, J.SINGLE)
            q = q or SB.start_board(spark, log, "memory", ckpt, output_mode="update", query_name="late_board", dedupe_keys=J.KEYS[J.SINGLE][2:])
            q.processAllAvailable()
        dropped = SB.dropped_late_rows(q)
        got = spark.sql("SELECT window_start, max(n) AS n FROM late_board GROUP BY window_start").collect()
    finally:
        q.stop()
    assert dropped >= 1
    assert {(r.window_start, r.n) for r in got} == {(36000, 4)}
