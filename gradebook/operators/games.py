"""Judgment normalisation (W1-W3) and lookup (Q1-Q2).

Keep-last semantics of an append-only log are expressed with ``max_by`` over an
explicit sequence column, so they hold under any partitioning and are partially
aggregated map-side (a hot key never gathers its rows in one task).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.templates import render

JUDGE = ["judge_model", "judge_prompt"]


def resolved_winner(df: DataFrame) -> Column:
    """Explicit ``winner`` if present, else g1 when both games agree, else
    ``inconsistent``; a row with neither is an error."""
    from_games = (F.when(F.col("g1_winner").isNull() | F.col("g2_winner").isNull(),
                         F.raise_error(F.lit("judgment row has neither winner nor g1/g2 winners")))
                  .when(F.col("g1_winner") == F.col("g2_winner"), F.col("g1_winner"))
                  .otherwise(F.lit(fixed.WINNER_INCONSISTENT)))
    if "winner" in df.columns:
        return F.coalesce(F.col("winner"), from_games)
    return from_games


def _reverse_label(c: Column) -> Column:
    return (F.when(c == fixed.WINNER_MODEL_1, F.lit(fixed.WINNER_MODEL_2))
            .when(c == fixed.WINNER_MODEL_2, F.lit(fixed.WINNER_MODEL_1))
            .otherwise(c))


def canonical_games(judgments: DataFrame, seq: str = "seq") -> DataFrame:
    """One game per (judge, question, unordered model pair).

    Stage a: per raw key (judge, qid, model_1, model_2) the last row wins and the
    key remembers when it was first seen.  Stage b: keys are put in canonical
    order (model_1 < model_2; on a swap the winner label reverses and the two
    game texts trade places) and the raw key first seen latest wins.
    """
    raw_key = [*JUDGE, "question_id", "model_1", "model_2"]
    payload = F.struct(resolved_winner(judgments).alias("winner"), "g1_judgment", "g2_judgment")
    a = judgments.groupBy(*raw_key).agg(
        F.max_by(payload, F.col(seq)).alias("last"), F.min(seq).alias("first_seen"))
    swap = ~(F.col("model_1") < F.col("model_2"))
    canon = a.select(
        *JUDGE, "question_id", "first_seen",
        F.when(swap, F.col("model_2")).otherwise(F.col("model_1")).alias("model_1"),
        F.when(swap, F.col("model_1")).otherwise(F.col("model_2")).alias("model_2"),
        F.struct(
            F.when(swap, _reverse_label(F.col("last.winner"))).otherwise(F.col("last.winner")).alias("winner"),
            F.when(swap, F.col("last.g2_judgment")).otherwise(F.col("last.g1_judgment")).alias("g1_judgment"),
            F.when(swap, F.col("last.g1_judgment")).otherwise(F.col("last.g2_judgment")).alias("g2_judgment"),
        ).alias("v"),
    )
    b = canon.groupBy(*JUDGE, "question_id", "model_1", "model_2").agg(
        F.max_by("v", "first_seen").alias("v"))
    return b.select(*JUDGE, "question_id", "model_1", "model_2", "v.*")


def default_prompt_name(category: Column, n_turns: Column) -> Column:
    """Q1 prompt choice: math-family prompt for reference categories, and the
    multi-turn variant for multi-turn questions."""
    base = F.when(category.isin(*fixed.NEED_REF_CATS), F.lit("pair-math-v1")).otherwise(F.lit("pair-v2"))
    return F.concat(base, F.when(n_turns > 1, F.lit("-multi-turn")).otherwise(F.lit("")))


def resolve_default_judge(questions: DataFrame, games: DataFrame) -> DataFrame:
    """Q1: per question the default judge (prompt by category/turns; the preferred
    judge model when it judged with that prompt anywhere, else the fallback) and
    the number of canonical games held under it.

    The games are read once, for their counts by judge, prompt and question, which are stored: availability is the distinct
    (judge, prompt) set of the same table.
    """
    from gradebook.session import materialize

    counts = materialize(games.groupBy(*JUDGE, "question_id").agg(F.count("*").alias("n_games")), f"game-counts-{uuid.uuid4().hex}")
    avail = counts.select(*JUDGE).distinct()
    pref = avail.filter(F.col("judge_model") == fixed.PREFERRED_JUDGE).select(
        F.col("judge_prompt").alias("prompt"), F.lit(True).alias("has_pref"))
    q = questions.select("question_id", "category", "n_turns",
                         default_prompt_name(F.col("category"), F.col("n_turns")).alias("prompt"))
    q = q.join(pref, "prompt", "left")
    q = q.select(
        "question_id", "category", "n_turns",
        F.when(F.col("has_pref"), F.lit(fixed.PREFERRED_JUDGE)).otherwise(F.lit(fixed.FALLBACK_JUDGE)).alias("judge_model"),
        F.col("prompt").alias("judge_prompt"))
    out = q.join(counts, [*JUDGE, "question_id"], "left")
    return out.select("question_id", "category", "n_turns", *JUDGE,
                      F.coalesce("n_games", F.lit(0)).cast("long").alias("n_games"))


def explanations(requests: DataFrame, games: DataFrame, judge_model: str, judge_prompt: str) -> DataFrame:
    """Q2: explanation text of each requested (question_id, model_1, model_2) game
    in the caller's orientation, or ``N/A`` when the judge never played it."""
    g = games.filter((F.col("judge_model") == judge_model) & (F.col("judge_prompt") == judge_prompt)).select(
        "question_id", F.col("model_1").alias("c1"), F.col("model_2").alias("c2"),
        F.col("g1_judgment").alias("j1"), F.col("g2_judgment").alias("j2"))
    lo_first = F.col("model_1") < F.col("model_2")
    r = requests.select(
        "question_id", "model_1", "model_2",
        F.when(lo_first, F.col("model_1")).otherwise(F.col("model_2")).alias("c1"),
        F.when(lo_first, F.col("model_2")).otherwise(F.col("model_1")).alias("c2"),
        lo_first.alias("direct"))
    j = r.join(g, ["question_id", "c1", "c2"], "left")
    text = render(fixed.EXPLANATION_FORMAT, {
        "model_1": F.col("model_1"), "model_2": F.col("model_2"),
        "g1_judgment": F.when(F.col("direct"), F.col("j1")).otherwise(F.col("j2")),
        "g2_judgment": F.when(F.col("direct"), F.col("j2")).otherwise(F.col("j1")),
    })
    return j.select("question_id", "model_1", "model_2",
                    F.when(F.col("j1").isNull() & F.col("j2").isNull(), F.lit(fixed.EXPLANATION_MISSING))
                    .otherwise(text).alias("explanation"))
