"""Judging and leaderboard queries (V*, W*, Q*, A1-A9, A15, T*, U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.operators import boards as B
from gradebook.operators import verdicts as V
from gradebook.operators.joins import attach_labels
from gradebook.plans import fixtures as fx
from gradebook.plans.oracle_views import with_views
from gradebook.plans.registry import register
from gradebook.plans.sql_snippets import GAMES, LABELED_GAMES, RATING, outcomes

BASELINE = "m0"


def labeled_games(spark, sf):
    games = V.with_game_winners(fx.pair_log(spark, sf))
    return attach_labels(games, fx.question_labels(spark, sf), ["label", "label2"])


def labeled_single(spark, sf):
    s = V.with_rating(fx.single_log(spark, sf))
    return attach_labels(s, fx.question_labels(spark, sf), ["label", "label2"])


# ---------------------------------------------------------------------------
# Verdict parsing
# ---------------------------------------------------------------------------

@register("pair_verdict", with_views(["pair_log"], f"""
, {GAMES}
SELECT seq, question_id, model_1, model_2, g1_winner, g2_winner FROM games""".lstrip()))
def pair_verdict(spark, sf):
    g = V.with_game_winners(fx.pair_log(spark, sf))
    return g.select("seq", "question_id", "model_1", "model_2", "g1_winner", "g2_winner")


@register("rating_extract", with_views(["single_log"], f"""
SELECT question_id, model, turn, judgment, {RATING} AS score FROM single_log"""))
def rating_extract(spark, sf):
    return V.with_rating(fx.single_log(spark, sf)).select("question_id", "model", "turn", "judgment", "score")


_TWO, _TWO_B = f"'{fixed.TWO_SCORE_PATTERN}'", f"'{fixed.TWO_SCORE_PATTERN_BACKUP}'"


@register("score_pair_verdict", with_views(["two_score_log"], f"""
, s AS (
  SELECT seq, judgment,
    CASE WHEN regexp_matches(judgment, {_TWO})
         THEN try_cast(regexp_extract(judgment, {_TWO}, 1) AS DOUBLE)
         ELSE try_cast(nullif(regexp_extract(judgment, {_TWO_B}, 1), '') AS DOUBLE) END AS score_a,
    CASE WHEN regexp_matches(judgment, {_TWO})
         THEN try_cast(regexp_extract(judgment, {_TWO}, 2) AS DOUBLE)
         ELSE try_cast(nullif(regexp_extract(judgment, {_TWO_B}, 2), '') AS DOUBLE) END AS score_b
  FROM two_score_log)
SELECT seq, judgment, score_a, score_b,
  CASE WHEN score_a IS NULL OR score_b IS NULL THEN 'error'
       WHEN abs(score_a - score_b) <= CAST(0.1 AS DOUBLE) THEN 'tie'
       WHEN score_a > score_b THEN 'A' ELSE 'B' END AS winner
FROM s""".lstrip()))
def score_pair_verdict(spark, sf):
    return V.with_two_score_verdict(fx.two_score_log(spark, sf)).select(
        "seq", "judgment", "score_a", "score_b", "winner")


# ---------------------------------------------------------------------------
# Pairwise boards
# ---------------------------------------------------------------------------

def _board_sql(group: str, where: str = "", baseline_filter: str = "", order: str = "") -> str:
    return with_views(["pair_log", "question_labels"], f"""
, {GAMES}, {LABELED_GAMES}, {outcomes("(SELECT * FROM lgames " + where + ")", "label, label2")}
SELECT {group}{"," if group else ""} model, CAST(sum(win) AS BIGINT) AS win, CAST(sum(loss) AS BIGINT) AS loss,
       CAST(sum(tie) AS BIGINT) AS tie,
       CAST(sum(win) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS win_rate,
       CAST(sum(loss) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS loss_rate
FROM outcomes {baseline_filter}
GROUP BY {group}{"," if group else ""} model""".lstrip())


@register("win_board", _board_sql(""))
def win_board(spark, sf):
    return B.win_board(labeled_games(spark, sf))


@register("win_board_baseline", _board_sql(
    "", where=f"WHERE model_1 = '{BASELINE}' OR model_2 = '{BASELINE}'",
    baseline_filter=f"WHERE model <> '{BASELINE}'"))
def win_board_baseline(spark, sf):
    return B.win_board(labeled_games(spark, sf), baseline=BASELINE)


@register("win_board_by_label", _board_sql("label, label2"))
def win_board_by_label(spark, sf):
    return B.win_board(labeled_games(spark, sf), labels=["label", "label2"])


@register("win_board_levels", with_views(["pair_log", "question_labels"], f"""
, {GAMES}, {LABELED_GAMES}, {outcomes("lgames", "label, label2")}
SELECT CASE WHEN grouping(label, label2, model) = 0 THEN 'label' ELSE 'all' END AS level,
       label, label2, model, CAST(sum(win) AS BIGINT) AS win, CAST(sum(loss) AS BIGINT) AS loss,
       CAST(sum(tie) AS BIGINT) AS tie,
       CAST(sum(win) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS win_rate,
       CAST(sum(loss) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS loss_rate
FROM outcomes GROUP BY GROUPING SETS ((model), (label, label2, model))
HAVING grouping(label, label2, model) <> 0 OR (label IS NOT NULL AND label2 IS NOT NULL)""".lstrip()))
def win_board_levels(spark, sf):
    return B.win_board_levels(labeled_games(spark, sf), ["label", "label2"])


@register("win_board_markdown", with_views(["pair_log", "question_labels"], f"""
, {GAMES}, {LABELED_GAMES}, {outcomes("lgames", "label, label2")},
b AS (SELECT model, CAST(sum(win) AS BIGINT) AS win, CAST(sum(loss) AS BIGINT) AS loss, CAST(sum(tie) AS BIGINT) AS tie
      FROM outcomes GROUP BY model)
SELECT 0 AS part, '| model | win | loss | tie |' AS line
UNION ALL SELECT 1, '|---|---|---|---|'
UNION ALL SELECT 2, '| ' || model || ' | ' || CAST(win AS VARCHAR) || ' | ' || CAST(loss AS VARCHAR) || ' | '
                    || CAST(tie AS VARCHAR) || ' |' FROM b""".lstrip()))
def win_board_markdown(spark, sf):
    from gradebook.sources.writers import markdown_lines
    board = B.win_board(labeled_games(spark, sf)).select("model", "win", "loss", "tie")
    return markdown_lines(board).select("part", "line")


@register("head_to_head", with_views(["pair_log", "question_labels"], f"""
, {GAMES}, {LABELED_GAMES}, {outcomes("lgames")}
SELECT model AS baseline, opponent, CAST(sum(win) AS BIGINT) AS win, CAST(sum(loss) AS BIGINT) AS loss,
       CAST(sum(tie) AS BIGINT) AS tie,
       CAST(sum(win) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS win_rate,
       CAST(sum(tie) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS tie_rate,
       CAST(sum(loss) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS loss_rate
FROM outcomes GROUP BY model, opponent""".lstrip()))
def head_to_head(spark, sf):
    return B.head_to_head(labeled_games(spark, sf))


_M = fx.MODELS


@register("win_matrix", with_views(["pair_log", "question_labels"], f"""
, {GAMES}, {LABELED_GAMES}, {outcomes("lgames")},
h AS (SELECT model, opponent, CAST(sum(win) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS r
      FROM outcomes GROUP BY model, opponent)
SELECT model, {", ".join(f"max(CASE WHEN opponent = '{m}' AND model <> '{m}' THEN r END) AS {m}" for m in _M)},
       round(avg(r), 12) AS mean_win_rate
FROM h GROUP BY model""".lstrip()))
def win_matrix(spark, sf):
    m = B.win_matrix(labeled_games(spark, sf), models=fx.MODELS)
    return m.withColumn("mean_win_rate", F.round("mean_win_rate", 12))


# ---------------------------------------------------------------------------
# Single-score boards
# ---------------------------------------------------------------------------

_SCORED = f"""scored AS (
  SELECT s.*, {RATING} AS score, l.label, l.label2
  FROM single_log s JOIN question_labels l ON s.question_id = l.question_id)"""


@register("score_board", with_views(["single_log", "question_labels"], f"""
, {_SCORED}
SELECT model, avg(score) AS score, count(*) AS n FROM scored GROUP BY model""".lstrip()))
def score_board(spark, sf):
    return B.score_board(labeled_single(spark, sf))


@register("score_board_by_turn", with_views(["single_log", "question_labels"], f"""
, {_SCORED}
SELECT model, turn, avg(score) AS score, count(*) AS n FROM scored WHERE score <> -1 GROUP BY model, turn""".lstrip()))
def score_board_by_turn(spark, sf):
    return B.score_board(labeled_single(spark, sf), by_turn=True, exclude_unparsed=True)


@register("score_board_by_label", with_views(["single_log", "question_labels"], f"""
, {_SCORED}
SELECT label, label2, model, avg(score) AS score, count(*) AS n FROM scored
WHERE label IS NOT NULL AND label2 IS NOT NULL GROUP BY label, label2, model""".lstrip()))
def score_board_by_label(spark, sf):
    return B.score_board(labeled_single(spark, sf), labels=["label", "label2"])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("score_matrix", with_views(["single_log", "question_labels"], f"""
, {_SCORED}
SELECT model, {", ".join(f"avg(CASE WHEN label = '{s}' THEN score END) AS {s}" for s in SEGMENTS)}
FROM scored GROUP BY model""".lstrip()))
def score_matrix(spark, sf):
    return B.score_matrix(labeled_single(spark, sf), "label", SEGMENTS)


@register("radar_series", with_views(["single_log", "question_labels"], f"""
, {_SCORED},
v AS (SELECT model, label, avg(score) AS score FROM scored GROUP BY model, label),
ax AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS k,
              count(*) OVER () AS n FROM (SELECT DISTINCT label FROM v)),
pts AS (SELECT v.model, v.label, ax.k, ax.n, v.score FROM v JOIN ax ON v.label = ax.label)
SELECT model, label, k, round(2 * pi() * k / n, 9) AS angle, score FROM pts
UNION ALL
SELECT model, label, n AS k, round(2 * pi() * n / n, 9) AS angle, score FROM pts WHERE k = 0""".lstrip()))
def radar_series(spark, sf):
    s = labeled_single(spark, sf).groupBy("model", "label").agg(F.avg("score").alias("score"))
    r = B.radar_series(s, "model", "label", "score")
    return r.withColumn("angle", F.round("angle", 9))


# ---------------------------------------------------------------------------
# Streaming board (R8), batch form; tests run the same plan as a stream
# ---------------------------------------------------------------------------

@register("stream_board", """
WITH j AS (SELECT 'm' || CAST(event_id % 4 AS VARCHAR) AS model,
                  CAST(CAST(floor(value) AS BIGINT) % 10 + 1 AS DOUBLE) AS s, ts FROM events)
SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS window_start, model,
       count(*) AS n, sum(s) AS score_sum, avg(s) AS score_avg
FROM j GROUP BY 1, 2""")
def stream_board(spark, sf):
    from gradebook.streaming.board import scored_events, windowed_board
    return windowed_board(scored_events(fx.judgment_stream_log(spark, sf)))


_LATEST_PAIR = f"""
, {GAMES},
l AS (SELECT bench, judge_model, judge_prompt, question_id, model_1, model_2, turn,
             arg_max(g1_winner, tstamp) AS g1_winner, arg_max(g2_winner, tstamp) AS g2_winner
      FROM games GROUP BY bench, judge_model, judge_prompt, question_id, model_1, model_2, turn)"""


@register("stream_win_board", with_views(["pair_log"], f"""{_LATEST_PAIR},
{outcomes("l", "bench, judge_model")}
SELECT bench, judge_model, 'none' AS iid, model, CAST(sum(win) AS BIGINT) AS win, CAST(sum(loss) AS BIGINT) AS loss, CAST(sum(tie) AS BIGINT) AS tie,
       CAST(sum(win) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS win_rate,
       CAST(sum(loss) AS DOUBLE) / CAST(sum(win) + sum(loss) + sum(tie) AS DOUBLE) AS loss_rate
FROM outcomes GROUP BY bench, judge_model, model""".lstrip()))
def stream_win_board(spark, sf):
    """The pairwise board that the stream keeps (re-judged games count once), from the whole log."""
    from gradebook.streaming.latest import batch_board
    log = V.with_game_winners(fx.pair_log(spark, sf)).withColumns({"iid": F.lit("none"), "commit": F.lit("")})
    return batch_board(log, "pair")


@register("stream_latest_board", """
WITH j AS (SELECT user_id, 'm' || CAST(event_id % 4 AS VARCHAR) AS model, CAST(CAST(floor(value) AS BIGINT) % 10 + 1 AS DOUBLE) AS s, ts FROM events),
l AS (SELECT user_id, model, arg_max(s, CAST(s AS VARCHAR)) AS s FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, model) AS last FROM j) WHERE ts = last GROUP BY user_id, model)
SELECT 'none' AS bench, 'gpt-4' AS judge_model, 'none' AS iid, model, count(*) AS n, sum(s) AS score_sum, sum(s) / CAST(count(*) AS DOUBLE) AS score
FROM l GROUP BY model""")
def stream_latest_board(spark, sf):
    """The score board that the stream keeps (the latest judgment of each key), from the whole log."""
    from gradebook.streaming.latest import batch_board
    log = V.with_rating(fx.judgment_stream_log(spark, sf)).withColumns({"bench": F.lit("none"), "iid": F.lit("none"), "commit": F.lit("")})
    return batch_board(log, "single")


# ---------------------------------------------------------------------------
# Model-list filter (C8; D15: accepted by every board)
# ---------------------------------------------------------------------------

SUBSET = ["m0", "m1", "m2"]
_SUBSET_SQL = ", ".join(f"'{m}'" for m in SUBSET)


@register("win_board_subset", _board_sql(
    "", where=f"WHERE model_1 IN ({_SUBSET_SQL}) AND model_2 IN ({_SUBSET_SQL})"))
def win_board_subset(spark, sf):
    from gradebook.operators.matches import filter_models
    return B.win_board(filter_models(labeled_games(spark, sf), SUBSET, ("model_1", "model_2")))


@register("score_board_subset", with_views(["single_log", "question_labels"], f"""
, {_SCORED}
SELECT model, avg(score) AS score, count(*) AS n FROM scored WHERE model IN ({_SUBSET_SQL}) GROUP BY model""".lstrip()))
def score_board_subset(spark, sf):
    from gradebook.operators.matches import filter_models
    return B.score_board(filter_models(labeled_single(spark, sf), SUBSET))


# ---------------------------------------------------------------------------
# Output-format dispatch (V6) over all three judgment shapes
# ---------------------------------------------------------------------------

def _fmt_sql() -> str:
    from gradebook import judge_prompts as JP
    cases = " ".join(f"WHEN '{n}' THEN '{t['output_format']}'" for n, t in JP.as_dict().items())
    return f"CASE judge_prompt {cases} END"


@register("verdict_dispatch", with_views(["pair_log", "single_log", "two_score_log"], f"""
, j AS (
  SELECT 'pair' AS kind, judge_prompt, g1_judgment AS judgment, {_fmt_sql()} AS fmt FROM pair_log
  UNION ALL SELECT 'single', judge_prompt, judgment, {_fmt_sql()} FROM single_log
  UNION ALL SELECT 'two_score', 'custom', judgment, '[[rating_a,rating_b]]' FROM two_score_log),
s AS (SELECT *,
  CASE WHEN regexp_matches(judgment, {_TWO}) THEN try_cast(regexp_extract(judgment, {_TWO}, 1) AS DOUBLE)
       ELSE try_cast(nullif(regexp_extract(judgment, {_TWO_B}, 1), '') AS DOUBLE) END AS a,
  CASE WHEN regexp_matches(judgment, {_TWO}) THEN try_cast(regexp_extract(judgment, {_TWO}, 2) AS DOUBLE)
       ELSE try_cast(nullif(regexp_extract(judgment, {_TWO_B}, 2), '') AS DOUBLE) END AS b
  FROM j)
SELECT kind, judge_prompt, judgment,
  CASE fmt
    WHEN '[[A]]' THEN CASE WHEN contains(judgment, '[[A]]') THEN 'A' WHEN contains(judgment, '[[B]]') THEN 'B'
                           WHEN contains(judgment, '[[C]]') THEN 'tie' ELSE 'error' END
    WHEN '[[rating_a,rating_b]]' THEN CASE WHEN a IS NULL OR b IS NULL THEN 'error'
                           WHEN abs(a - b) <= CAST(0.1 AS DOUBLE) THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END
    WHEN '[[rating]]' THEN CAST({RATING} AS VARCHAR) END AS verdict
FROM s""".lstrip()))
def verdict_dispatch(spark, sf):
    from gradebook import judge_prompts as JP
    from gradebook.functions.extract import verdict_by_format
    cat = JP.as_dict()
    fmt = F.create_map(*[x for n, t in cat.items() for x in (F.lit(n), F.lit(t["output_format"]))])
    pair = fx.pair_log(spark, sf).select(F.lit("pair").alias("kind"), "judge_prompt",
                                         F.col("g1_judgment").alias("judgment"))
    single = fx.single_log(spark, sf).select(F.lit("single").alias("kind"), "judge_prompt", "judgment")
    j = pair.unionByName(single).withColumn("fmt", F.try_element_at(fmt, F.col("judge_prompt")))
    two = fx.two_score_log(spark, sf).select(F.lit("two_score").alias("kind"), F.lit("custom").alias("judge_prompt"),
                                             "judgment", F.lit("[[rating_a,rating_b]]").alias("fmt"))
    return j.unionByName(two).select("kind", "judge_prompt", "judgment",
                                     verdict_by_format("judgment", "fmt").alias("verdict"))
