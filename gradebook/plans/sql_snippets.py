"""Reusable oracle SQL fragments (DuckDB) for parsed judgments and outcomes."""

from __future__ import annotations


def letter(col: str, a: str, b: str) -> str:
    """V2 + V4 in SQL: positional verdict mapped to model labels."""
    return (f"CASE WHEN contains({col}, '[[A]]') THEN '{a}' "
            f"WHEN contains({col}, '[[B]]') THEN '{b}' "
            f"WHEN contains({col}, '[[C]]') THEN 'tie' ELSE 'error' END")


# pair_log with both game winners
GAMES = f"""games AS (
  SELECT p.*, {letter('g1_judgment', 'model_1', 'model_2')} AS g1_winner,
              {letter('g2_judgment', 'model_2', 'model_1')} AS g2_winner
  FROM pair_log p)"""

LABELED_GAMES = """lgames AS (
  SELECT g.*, l.label, l.label2 FROM games g JOIN question_labels l ON g.question_id = l.question_id)"""


def outcomes(src: str, extra: str = "") -> str:
    """A4 in SQL: two rows per game (model, opponent, win, loss, tie)."""
    code = ("CASE WHEN g1_winner = 'tie' OR g1_winner IS DISTINCT FROM g2_winner OR g1_winner = 'error' "
            "OR g2_winner = 'error' THEN 0 WHEN g1_winner = 'model_1' THEN 1 "
            "WHEN g1_winner = 'model_2' THEN 2 ELSE -1 END")
    ex = (extra + ", ") if extra else ""
    return f"""oc AS (SELECT *, {code} AS code FROM {src}),
  outcomes AS (
    SELECT {ex}model_1 AS model, model_2 AS opponent,
           CAST(code = 1 AS BIGINT) AS win, CAST(code = 2 AS BIGINT) AS loss,
           CAST(code IN (0, -1) AS BIGINT) AS tie FROM oc
    UNION ALL
    SELECT {ex}model_2 AS model, model_1 AS opponent,
           CAST(code = 2 AS BIGINT) AS win, CAST(code = 1 AS BIGINT) AS loss,
           CAST(code IN (0, -1) AS BIGINT) AS tie FROM oc)"""


# V1 rating in SQL
RATING = """coalesce(
    try_cast(nullif(regexp_extract(judgment, '\\[\\[(\\d+\\.?\\d*)\\]\\]', 1), '') AS DOUBLE),
    try_cast(nullif(regexp_extract(judgment, '\\[(\\d+\\.?\\d*)\\]', 1), '') AS DOUBLE),
    -1.0)"""


# ---------------------------------------------------------------------------
# Multiple-choice letter cascade in RE2 syntax
# ---------------------------------------------------------------------------

# RE2's \s is ASCII only; Python's str patterns are Unicode aware.
from gradebook.functions.text import PY_WS as _WS  # noqa: E402


def _re2(p: str) -> str:
    return p.replace(r"\s", _WS).replace("\\（", "（").replace("\\）", "）")


def ustrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def mc_letter_sql(x: str) -> str:
    """E1+E2 in SQL over an already stripped text expression ``x``."""
    from gradebook import fixed
    cascade = ", ".join(
        f"list_extract(regexp_extract_all({x}, '{_re2(p)}', 1), -1)" for p in fixed.MC_ANSWER_PATTERNS)
    return (f"CASE WHEN length({x}) = 0 THEN NULL "
            f"WHEN substr({x}, 1, 1) IN ('A', 'B', 'C', 'D') THEN substr({x}, 1, 1) "
            f"ELSE coalesce({cascade}) END")
