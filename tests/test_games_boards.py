"""Keep-last, game canonicalisation and boards: Python models and metamorphic checks."""

import random

import pytest
from pyspark.sql import functions as F

from gradebook.operators import boards as B
from gradebook.operators import games as G
from gradebook.operators.keeplast import compact_log, keep_last

MODELS = ["a", "b", "c"]
WINNERS = ["model_1", "model_2", "tie", "error"]


def random_log(n, seed):
    rnd = random.Random(seed)
    rows = []
    for seq in range(n):
        m1, m2 = rnd.choice(MODELS), rnd.choice(MODELS)
        rows.append(("j", "p", rnd.randint(0, 3), m1, m2, rnd.choice(WINNERS), rnd.choice(WINNERS),
                     f"g1-{seq}", f"g2-{seq}", seq))
    return rows


SCHEMA = ("judge_model string, judge_prompt string, question_id long, model_1 string, model_2 string, "
          "g1_winner string, g2_winner string, g1_judgment string, g2_judgment string, seq long")


def py_canonical(rows):
    """Plain-Python model of the two-stage keep-last (dict insertion semantics)."""
    rev = {"model_1": "model_2", "model_2": "model_1"}
    raw = {}
    for (_, _, q, m1, m2, w1, w2, j1, j2, _) in rows:
        w = w1 if w1 == w2 else "inconsistent"
        raw[(q, m1, m2)] = (w, j1, j2)
    out = {}
    for (q, m1, m2), (w, j1, j2) in raw.items():
        if m1 < m2:
            out[(q, m1, m2)] = (w, j1, j2)
        else:
            out[(q, m2, m1)] = (rev.get(w, w), j2, j1)
    return out


def test_canonical_games_matches_python_model(spark):
    for seed in range(3):
        rows = random_log(300, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {(r.question_id, r.model_1, r.model_2): (r.winner, r.g1_judgment, r.g2_judgment)
               for r in G.canonical_games(df).collect()}
        assert got == py_canonical(rows)


def test_canonical_games_ignores_partitioning(spark):
    rows = random_log(200, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    a = sorted(map(tuple, G.canonical_games(df).collect()))
    b = sorted(map(tuple, G.canonical_games(df.repartition(7).orderBy(F.rand(3))).collect()))
    assert a == b


def test_keep_last_and_compaction(spark):
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 5), (2, "z", 3), (1, "w", 2)], "question_id long, v string, seq long")
    assert sorted(map(tuple, keep_last(df, ["question_id"]).collect())) == [(1, "y", 5), (2, "z", 3)]
    assert [r.question_id for r in compact_log(df, partitions=2).collect()] == [1, 2]


def pair_rows(seed, n=400):
    rnd = random.Random(seed)
    return [(i, rnd.choice(MODELS), rnd.choice([m for m in MODELS]), rnd.choice(WINNERS), rnd.choice(WINNERS))
            for i in range(n)]


PSCHEMA = "question_id long, model_1 string, model_2 string, g1_winner string, g2_winner string"


def test_board_invariants(spark):
    df = spark.createDataFrame(pair_rows(1), PSCHEMA)
    board = B.win_board(df).collect()
    assert sum(r.win for r in board) == sum(r.loss for r in board)
    assert sum(r.win + r.loss + r.tie for r in board) == 2 * df.count()


def test_board_swap_invariance(spark):
    df = spark.createDataFrame(pair_rows(2), PSCHEMA)
    flip = {"model_1": "model_2", "model_2": "model_1"}
    swapped = spark.createDataFrame(
        [(q, m2, m1, flip.get(w2, w2), flip.get(w1, w1)) for q, m1, m2, w1, w2 in pair_rows(2)], PSCHEMA)
    a = sorted(map(tuple, B.win_board(df).collect()))
    b = sorted(map(tuple, B.win_board(swapped).collect()))
    assert a == b


def test_outcome_rules(spark):
    rows = [(0, "a", "b", "tie", "tie"), (1, "a", "b", "model_1", "model_2"), (2, "a", "b", "error", "error"),
            (3, "a", "b", "model_1", "model_1"), (4, "a", "b", "model_2", "model_2"), (5, "a", "b", "odd", "odd")]
    out = B.pair_outcomes(spark.createDataFrame(rows, PSCHEMA)).collect()
    by = {}
    for r in out:
        w, l, t, u = by.get(r.model, (0, 0, 0, 0))
        by[r.model] = (w + r.win, l + r.loss, t + r.tie, u + r.unknown)
    assert by["a"] == (1, 1, 4, 1)
    assert by["b"] == (1, 1, 4, 1)


def test_baseline_board_drops_baseline(spark):
    df = spark.createDataFrame(pair_rows(3), PSCHEMA)
    models = {r.model for r in B.win_board(df, baseline="a").collect()}
    assert "a" not in models


def test_macro_vs_micro_accuracy(spark):
    rows = [("m", 0, False, "x", 1)] * 3 + [("m", 0, False, "y", 0)]
    df = spark.createDataFrame(rows, "model string, ntrain int, cot boolean, category string, correct int")
    acc = {r.category: r.acc for r in B.mc_accuracy(df).collect()}
    assert acc == {"x": 100.0, "y": 0.0, "ALL": 50.0}   # micro would be 75.0


def test_win_matrix_null_diagonal_and_never_met(spark):
    rows = [(0, "a", "b", "model_1", "model_1"), (1, "b", "c", "tie", "tie")]
    m = {r.model: r for r in B.win_matrix(spark.createDataFrame(rows, PSCHEMA), ["a", "b", "c"]).collect()}
    assert m["a"]["a"] is None and m["a"]["c"] is None and m["a"]["b"] == 1.0


def py_share_cut(rows, p):
    """Exact fractions of the doubles, one group at a time: (group, id) -> (share, kept share)."""
    import math
    from fractions import Fraction
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((-Fraction(v), i) for x, i, v in rows if x == g and v is not None and math.isfinite(v))
        total, before, kept = -sum(v for v, _ in own), Fraction(0), []
        for v, i in own:
            if before <= Fraction(str(p)) * total:
                kept.append((i, -v))
            before -= v
        left = sum(v for _, v in kept)
        out |= {(g, i): (float(v / total) if total else None, float(v / left) if left else None) for i, v in kept}
    return out


@pytest.mark.parametrize("held", [1 << 20, 3])
def test_share_cut_is_exact_for_any_values_and_partitions(spark, held):
    import random
    from gradebook.operators.shares import cumulative_share_cut
    rnd = random.Random(held)
    rows = [(str(n), i, 1.0) for n in (10, 28, 50, 101, 500) for i in range(n)]               # equal values: ties at the cut
    rows += [("tenths", i, float(1 + (i * 37) % 11) / 10) for i in range(300)]
    rows += [("wide", i, 10.0 ** rnd.uniform(-12, 13)) for i in range(200)]
    rows += [("tiny", i, 4e-7) for i in range(10)] + [("least", i, 5e-324) for i in range(9)] + [("great", i, 1e13 + i) for i in range(9)]
    rows += [("probabilities", i, x) for i, x in enumerate(rnd.random() ** 40 for _ in range(300))]
    rows += [(None, 1, 2.0), (None, 2, 1.0), ("zero", 1, 0.0), ("zero", 2, 0.0), ("one", 1, 3.5), ("odd", 1, None), ("odd", 2, float("nan")), ("odd", 3, float("inf")),
             ("odd", 4, 1.0), ("signs", 1, 3.0), ("signs", 2, -1.0), ("signs", 3, 1e-300)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for p in (0.6, 0.9, 0.1):
            want = py_share_cut(rows, p)
            for n in (3, 11):
                spark.conf.set("spark.sql.shuffle.partitions", n)
                got = {(r.g, r.id): (r.share, r.kept_share) for r in cumulative_share_cut(df, "g", "v", p, ["id"], held=held).collect()}
                assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_share_cut_tells_the_groups_of_a_batch_together(spark):
    """2,500 groups of four rows in one partition: a few batches, not one for every group."""
    from fractions import Fraction

    from gradebook.operators.shares import _first_pass

    def batches(rows):
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in _first_pass(Fraction("0.6"), 0, 1, 1 << 20)(rows)], pa.int64())], ["n"])

    rows = spark.range(10_000).selectExpr("id div 4 as g", "double(4 - id % 4) as v").coalesce(1).sortWithinPartitions("g", F.desc("v"))
    sizes = [r.n for r in rows.mapInArrow(batches, "n long").collect()]
    # 4 + 3 of 10 are kept (the 3 begins at 0.4, the 2 at 0.7); the first and last group are left to the second pass whole.
    assert sum(sizes) == 2_498 * 2 + 8 and len(sizes) < 20


def test_share_cut_of_nothing(spark):
    from gradebook.operators.shares import cumulative_share_cut
    out = cumulative_share_cut(spark.createDataFrame([], "g long, id long, v double"), "g", "v", 0.5, ["id"])
    assert out.columns == ["g", "id", "v", "share", "kept_share"] and out.count() == 0


def test_label_boards_leave_out_rows_without_a_label(spark):
    rows = [("a", "b", "model_1", "model_1", "x"), ("a", "b", "model_1", "model_1", None), ("b", "a", "tie", "tie", "x")]
    df = spark.createDataFrame(rows, "model_1 string, model_2 string, g1_winner string, g2_winner string, label string")
    got = {(r.label, r.model): (r.win, r.loss, r.tie) for r in B.win_board(df, labels=["label"]).collect()}
    assert got == {("x", "a"): (1, 0, 1), ("x", "b"): (0, 1, 1)}
    levels = {(r.level, r.label, r.model): r.win for r in B.win_board_levels(df, ["label"]).collect()}
    assert levels == {("label", "x", "a"): 1, ("label", "x", "b"): 0, ("all", None, "a"): 2, ("all", None, "b"): 0}

