"""Judgment parsing operators (V1-V5): judgment text -> scores and winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions import extract as X
from gradebook.operators.matches import pair_values


def with_rating(df: DataFrame, judgment: str = "judgment", out: str = "score") -> DataFrame:
    """V1: add the parsed single-answer rating (-1.0 when absent)."""
    return df.withColumn(out, X.rating(judgment))


def with_game_winners(df: DataFrame, g1: str = "g1_judgment", g2: str = "g2_judgment",
                      output_format: str = fixed.FORMAT_LETTER) -> DataFrame:
    """V2/V3 + V4: both games' verdicts mapped back to model_1/model_2.

    Game 1 shows (model_1, model_2) as (A, B); game 2 shows them swapped.
    """
    parse = X.letter_verdict if output_format == fixed.FORMAT_LETTER else X.two_score_verdict
    if output_format not in (fixed.FORMAT_LETTER, fixed.FORMAT_TWO_SCORES):
        raise ValueError(f"invalid output format: {output_format}")
    return df.select(
        "*",
        X.game_winner(parse(g1), swapped=False).alias("g1_winner"),
        X.game_winner(parse(g2), swapped=True).alias("g2_winner"),
    )


def with_two_score_verdict(df: DataFrame, judgment: str = "judgment") -> DataFrame:
    """V3: add both scores and the positional verdict."""
    a, b = X.two_scores(judgment)
    return (df.withColumn("score_a", a).withColumn("score_b", b)
            .withColumn("winner", X.score_verdict(F.col("score_a"), F.col("score_b"))))


def pair_from_scores(pairs: DataFrame, m1_score: str = "m1_score", m2_score: str = "m2_score") -> DataFrame:
    """V5: one pair outcome from two single scores; both games get the same winner."""
    s1, s2 = F.col(m1_score), F.col(m2_score)
    winner = (F.when(F.abs(s1 - s2) <= F.lit(fixed.TIE_DELTA), F.lit(fixed.WINNER_TIE))
              .when(s1 > s2, F.lit(fixed.WINNER_MODEL_1))
              .otherwise(F.lit(fixed.WINNER_MODEL_2)))
    return pairs.withColumn("g1_winner", winner).withColumn("g2_winner", winner)


def pairs_from_single(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """V5: single gradings (question_id, judge_prompt, turn, model, score; one row each) of the listed model pairs ->
    one outcome per question, prompt and turn."""
    return pair_from_scores(pair_values(scores, pairs, "score", "m1_score", "m2_score", ["question_id", "judge_prompt", "turn"]))
