"""Leaderboards (A1-A15, O1-O4): every board is one group-by over the judgments.

The per-baseline and per-label loops of a row-at-a-time implementation become a
single explode + ``groupBy`` (one shuffle, partial aggregation map-side), so hot
models or labels never concentrate rows in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.operators.joins import collect_small


def _rate(num: str, den: Column) -> Column:
    return F.try_divide(F.col(num).cast("double"), den.cast("double"))


# ---------------------------------------------------------------------------
# Pairwise outcomes
# ---------------------------------------------------------------------------

def outcome_code(g1: Column, g2: Column) -> Column:
    """A4 rule on a game pair: 1 model_1 won, 2 model_2 won, 0 tie, -1 unknown label.

    Tie when g1 is a tie, the games disagree, or either is an error.
    """
    tie = (g1 == fixed.WINNER_TIE) | (~g1.eqNullSafe(g2)) | (g1 == fixed.WINNER_ERROR) | (g2 == fixed.WINNER_ERROR)
    return (F.when(tie, F.lit(0))
            .when(g1 == fixed.WINNER_MODEL_1, F.lit(1))
            .when(g1 == fixed.WINNER_MODEL_2, F.lit(2))
            .otherwise(F.lit(-1)))


def pair_outcomes(pairs: DataFrame, baseline: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """A4/A5: each judged pair -> two rows (model, opponent, win, loss, tie, unknown).

    With ``baseline`` only games involving it are kept (filter before the explode).
    A winner label other than model_1/model_2/tie/error counts as a tie and is
    flagged in ``unknown``.
    """
    keep = keep or []
    if baseline is not None:
        pairs = pairs.filter((F.col("model_1") == baseline) | (F.col("model_2") == baseline))
    code = outcome_code(F.col("g1_winner"), F.col("g2_winner"))

    def side(me: str, other: str, win_code: int, loss_code: int) -> Column:
        return F.struct(
            F.col(me).alias("model"), F.col(other).alias("opponent"),
            (code == win_code).cast("long").alias("win"),
            (code == loss_code).cast("long").alias("loss"),
            ((code == 0) | (code == -1)).cast("long").alias("tie"),
            (code == -1).cast("long").alias("unknown"),
        )

    sides = F.explode(F.array(side("model_1", "model_2", 1, 2), side("model_2", "model_1", 2, 1)))
    return pairs.select(*keep, sides.alias("o")).select(*keep, "o.*")


def win_board(pairs: DataFrame, labels: list[str] | None = None, baseline: str | None = None) -> DataFrame:
    """A6/A7 (+O3): win/loss/tie sums and rates per model (and label combination).

    The baseline's own row is removed in baseline mode.
    """
    labels = labels or []
    o = pair_outcomes(pairs, baseline, keep=labels)
    for c in labels:                       # a row without a label is on no label's board
        o = o.where(F.col(c).isNotNull())
    g = o.groupBy(*labels, "model").agg(
        F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.sum("tie").alias("tie"))
    if baseline is not None:
        g = g.filter(F.col("model") != baseline)
    total = F.col("win") + F.col("loss") + F.col("tie")
    g = g.select("*", _rate("win", total).alias("win_rate"), _rate("loss", total).alias("loss_rate"))
    return g.orderBy(*[F.desc(c) for c in labels], F.desc("win_rate"), "model")


def win_board_levels(pairs: DataFrame, labels: list[str], baseline: str | None = None) -> DataFrame:
    """A6 + A7 in one aggregation: GROUPING SETS ((model), (labels..., model)).

    ``level`` is ``"all"`` for the overall rows (labels null) and ``"label"`` for
    the per-label rows; one shuffle serves both boards.
    """
    o = pair_outcomes(pairs, baseline, keep=labels)
    g = o.groupingSets([["model"], [*labels, "model"]], *labels, "model").agg(
        F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.sum("tie").alias("tie"),
        F.grouping_id().alias("_gid"))
    if baseline is not None:
        g = g.filter(F.col("model") != baseline)
    total = F.col("win") + F.col("loss") + F.col("tie")
    level = F.when(F.col("_gid") == 0, F.lit("label")).otherwise(F.lit("all"))
    for c in labels:                       # a row without a label is on no label's board
        g = g.where((F.col("_gid") != 0) | F.col(c).isNotNull())
    return g.select(level.alias("level"), *labels, "model", "win", "loss", "tie",
                    _rate("win", total).alias("win_rate"), _rate("loss", total).alias("loss_rate"))


def head_to_head(pairs: DataFrame) -> DataFrame:
    """Per (baseline, opponent) the baseline's win/tie/loss rates against it."""
    o = pair_outcomes(pairs)
    g = o.groupBy(F.col("model").alias("baseline"), "opponent").agg(
        F.sum("win").alias("win"), F.sum("loss").alias("loss"), F.sum("tie").alias("tie"))
    total = F.col("win") + F.col("loss") + F.col("tie")
    return g.select(
        "baseline", "opponent", "win", "loss", "tie",
        _rate("win", total).alias("win_rate"),
        _rate("tie", total).alias("tie_rate"),
        _rate("loss", total).alias("loss_rate"),
    )


def win_matrix(pairs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """Model x opponent win-rate matrix (null diagonal and null for never-met
    pairs), rows ordered by the model's mean win rate, descending.

    ``models`` fixes the pivot columns; by default the distinct model names are
    collected (a bounded list) so the pivot needs no extra distinct job later.
    """
    h = head_to_head(pairs)
    if models is None:
        names = (pairs.select(F.col("model_1").alias("m"))
                 .union(pairs.select(F.col("model_2").alias("m"))).distinct())
        models = sorted(r["m"] for r in collect_small(names))
    # One aggregation for the cells and the mean; a model's cell against itself stays null.
    cells = [F.max(F.when((F.col("opponent") == m) & (F.col("baseline") != m), F.col("win_rate"))).alias(m) for m in models]
    out = h.groupBy(F.col("baseline").alias("model")).agg(*cells, F.avg("win_rate").alias("mean_win_rate"))
    return out.orderBy(F.desc("mean_win_rate"), "model")


# ---------------------------------------------------------------------------
# Single-answer scores
# ---------------------------------------------------------------------------

def score_board(single: DataFrame, labels: list[str] | None = None, by_turn: bool = False,
                exclude_unparsed: bool = False) -> DataFrame:
    """A1/A2 (+O1/O2): mean score per model (per label combination, per turn).

    Unparsed ratings (-1) are included unless ``exclude_unparsed``; rows with a
    null label drop out of the per-label board.
    """
    labels = labels or []
    df = single
    if exclude_unparsed:
        df = df.filter(F.col("score") != -1)
    for lab in labels:
        df = df.filter(F.col(lab).isNotNull())
    keys = [*labels, "model", *(["turn"] if by_turn else [])]
    g = df.groupBy(*keys).agg(F.avg("score").alias("score"), F.count("*").alias("n"))
    return g.orderBy(*[F.desc(c) for c in labels], F.desc("score"), "model")


def score_matrix(single: DataFrame, label: str, values: list[str] | None = None) -> DataFrame:
    """A3: model x label-value matrix of mean scores (explicit pivot values)."""
    if values is None:
        values = sorted(r[label] for r in collect_small(single.select(label).distinct().dropna()))
    return single.groupBy("model").pivot(label, values).agg(F.avg("score"))


def radar_series(df: DataFrame, series: str, axis: str, value: str, axes: list | None = None,
                 max_axes: int = 10_000) -> DataFrame:
    """Points (series, axis, k, angle, value) with angle 2*pi*k/n; the first
    axis is repeated at k = n to close each polygon.

    Axis values are chart metadata: they are collected once (size-checked, at
    most ``max_axes``) and numbered in sorted order on the driver, and each row's
    index is a literal-map lookup, so no window or join is needed.
    """
    if axes is None:
        axes = sorted(r[axis] for r in collect_small(df.select(axis).distinct().dropna(), max_axes))
    n = len(axes)
    index = F.create_map(*[x for i, a in enumerate(axes) for x in (F.lit(a), F.lit(i).cast("long"))])
    pts = (df.select(series, axis, value, F.try_element_at(index, F.col(axis)).alias("k"))
           .filter(F.col("k").isNotNull()))
    closing = pts.filter(F.col("k") == 0).withColumn("k", F.lit(n).cast("long"))
    out = pts.unionByName(closing)
    return out.select(series, axis, "k", (F.lit(2 * math.pi) * F.col("k") / F.lit(n)).alias("angle"), value)


# ---------------------------------------------------------------------------
# Multiple choice
# ---------------------------------------------------------------------------

def percent2(x: Column) -> Column:
    """Percent with 2 decimals, half to even (numpy ``round(x*100, 2)``)."""
    return F.bround(x * F.lit(100.0), 2)


def mc_accuracy(results: DataFrame, run_cols: list[str] | None = None, macro_places: int | None = None) -> DataFrame:
    """Accuracy (%) per run and category plus the macro ``ALL`` row.

    ``ALL`` is the mean of the category means (not of the rows); ``macro_places`` rounds it
    before the percentage, for comparisons between engines that add in another order.
    """
    run_cols = run_cols or ["model", "ntrain", "cot"]
    cat = results.groupBy(*run_cols, "category").agg(F.avg("correct").alias("acc"))
    macro = cat.groupBy(*run_cols).agg((F.avg("acc") if macro_places is None else F.round(F.avg("acc"), macro_places)).alias("acc")).withColumn("category", F.lit("ALL"))
    both = cat.unionByName(macro)
    return both.select(*run_cols, "category", percent2(F.col("acc")).alias("acc"))


def subject_accuracy(results: DataFrame, run_cols: list[str] | None = None) -> DataFrame:
    """Correct count and accuracy (%) per run and subject."""
    run_cols = run_cols or ["model", "ntrain", "cot"]
    return results.groupBy(*run_cols, "subject").agg(
        F.sum("correct").cast("long").alias("n_correct"), F.count("*").alias("n"),
        percent2(F.avg("correct")).alias("acc"))


def runs_with_config(df: DataFrame, ntrain: int, cot: bool) -> DataFrame:
    """C11: the runs of one prompt configuration (real columns, not name tests)."""
    return df.filter((F.col("ntrain") == ntrain) & (F.col("cot") == F.lit(cot)))


def run_label(model: Column, ntrain: Column, cot: Column) -> Column:
    """``<model>_ntrain=<n>_cot=<True|False>`` as used for result folders."""
    cot_s = F.when(cot, F.lit("True")).otherwise(F.lit("False"))
    return F.concat(model, F.lit("_ntrain="), ntrain.cast("string"), F.lit("_cot="), cot_s)


def trim_run_label(label: Column) -> Column:
    """Drop the last two ``_``-separated parts (legend text)."""
    return F.regexp_replace(label, r"(_[^_]*){2}$", "")


def mc_runs_wide(acc: DataFrame, runs: list[str] | None = None) -> DataFrame:
    """Category rows x run columns (explicit pivot values)."""
    a = acc.withColumn("run", run_label(F.col("model"), F.col("ntrain"), F.col("cot")))
    if runs is None:
        runs = sorted(r["run"] for r in collect_small(a.select("run").distinct()))
    return a.groupBy("category").pivot("run", runs).agg(F.first("acc"))
