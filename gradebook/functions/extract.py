"""Verdict and answer extraction from free text.

All functions return Columns built from ``regexp_extract``/``regexp_extract_all``
and ``CASE`` chains; no Python runs per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.text import PY_WS, col_, ustrip


def _num(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern`` group as double; null when absent."""
    raw = F.regexp_extract(text, pattern, group)
    return F.when(raw == "", F.lit(None).cast("double")).otherwise(raw.try_cast("double"))


def rating(judgment: Column | str) -> Column:
    """V1: first ``[[n]]``, else first ``[n]``, else -1.0 (no range check).

    ``[[05]]`` casts to 5.0 and ``[[8.]]`` to 8.0.
    """
    j = col_(judgment)
    return F.coalesce(
        _num(j, fixed.ONE_SCORE_PATTERN),
        _num(j, fixed.ONE_SCORE_PATTERN_BACKUP),
        F.lit(-1.0),
    )


def letter_verdict(judgment: Column | str) -> Column:
    """V2: ``[[A]]`` -> A, else ``[[B]]`` -> B, else ``[[C]]`` -> tie, else error."""
    j = col_(judgment)
    return (
        F.when(j.contains("[[A]]"), F.lit("A"))
        .when(j.contains("[[B]]"), F.lit("B"))
        .when(j.contains("[[C]]"), F.lit(fixed.WINNER_TIE))
        .otherwise(F.lit(fixed.WINNER_ERROR))
    )


def two_scores(judgment: Column | str) -> tuple[Column, Column]:
    """V3 scores: ``[[x,y]]`` else ``[x,y]``; both from the same pattern."""
    j = col_(judgment)
    primary = F.regexp_extract(j, fixed.TWO_SCORE_PATTERN, 0) != ""
    a = F.when(primary, _num(j, fixed.TWO_SCORE_PATTERN, 1)).otherwise(
        _num(j, fixed.TWO_SCORE_PATTERN_BACKUP, 1))
    b = F.when(primary, _num(j, fixed.TWO_SCORE_PATTERN, 2)).otherwise(
        _num(j, fixed.TWO_SCORE_PATTERN_BACKUP, 2))
    return a, b


def score_verdict(a: Column, b: Column, delta: float = fixed.TIE_DELTA) -> Column:
    """Compare two scores in double: tie within ``delta``, else larger; null -> error."""
    return (
        F.when(a.isNull() | b.isNull(), F.lit(fixed.WINNER_ERROR))
        .when(F.abs(a - b) <= F.lit(float(delta)), F.lit(fixed.WINNER_TIE))
        .when(a > b, F.lit("A"))
        .otherwise(F.lit("B"))
    )


def two_score_verdict(judgment: Column | str) -> Column:
    """V3: verdict A/B/tie/error from a two-score judgment."""
    a, b = two_scores(judgment)
    return score_verdict(a, b)


def verdict_by_format(judgment: Column | str, output_format: Column | str) -> Column:
    """V6: dispatch on the template's output format; unknown formats raise."""
    fmt = col_(output_format)
    return (
        F.when(fmt == fixed.FORMAT_LETTER, letter_verdict(judgment))
        .when(fmt == fixed.FORMAT_TWO_SCORES, two_score_verdict(judgment))
        .when(fmt == fixed.FORMAT_RATING, rating(judgment).cast("string"))
        .otherwise(F.raise_error(F.concat(F.lit("invalid output format: "), F.coalesce(fmt, F.lit("null")))))
    )


def game_winner(position_verdict: Column, swapped: bool) -> Column:
    """V4: map positional A/B back to model_1/model_2 for game 1 (or swapped game 2)."""
    first, second = (fixed.WINNER_MODEL_2, fixed.WINNER_MODEL_1) if swapped else (
        fixed.WINNER_MODEL_1, fixed.WINNER_MODEL_2)
    return (
        F.when(position_verdict == "A", F.lit(first))
        .when(position_verdict == "B", F.lit(second))
        .otherwise(position_verdict)
    )


# ---------------------------------------------------------------------------
# Multiple choice
# ---------------------------------------------------------------------------

def _java_pattern(p: str) -> str:
    # Python's \s is Unicode aware; spell out the same class for Java.
    return p.replace(r"\s", PY_WS)


def mc_letter(response: Column | str, strict_first_letter: bool = False) -> Column:
    """E1+E2: answer letter of a response (null when none).

    A response starting with A-D answers by its first character (so "Because..."
    answers B).  Otherwise the first pattern of the cascade with any match wins,
    and its last match is the answer.  ``strict_first_letter`` requires the first
    letter to be followed by a delimiter or the end of the text.

    The stripped text is bound once, as the element of a one-element array; a text without any lead of the patterns
    (``MC_LEADS``, plain substrings) skips the cascade.
    """
    def letter(r: Column) -> Column:
        first = F.substring(r, 1, 1)
        first_ok = first.isin(*fixed.MC_CHOICES)
        if strict_first_letter:
            first_ok = first_ok & F.regexp_like(r, F.lit(r"(?U)^[A-D]([\s.,:;)、．。：]|$)"))
        cascade = F.coalesce(*[
            F.try_element_at(F.regexp_extract_all(r, F.lit(_java_pattern(p)), 1), F.lit(-1))
            for p in fixed.MC_ANSWER_PATTERNS
        ])
        led = reduce(lambda x, y: x | y, [r.contains(lead) for lead in fixed.MC_LEADS])
        return F.when(F.length(r) == 0, F.lit(None).cast("string")).when(first_ok, first).when(led, cascade)

    return F.get(F.transform(F.array(ustrip(col_(response))), letter), 0)


def letter_correct(letter: Column | str, answer: Column | str) -> Column:
    """1 when the letter equals the key (case-insensitive), else 0."""
    return F.coalesce((F.lower(col_(letter)) == F.lower(col_(answer))).cast("int"), F.lit(0))


def mc_correct(response: Column | str, answer: Column | str) -> Column:
    """E1-E3 in one: the letter extracted from the response equals the key."""
    return letter_correct(mc_letter(response), answer)
