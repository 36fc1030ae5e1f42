"""Question-answer queries: conversion, answers, matches, prompts, games."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradebook import fixed
from gradebook import judge_prompts as JP
from gradebook.functions.templates import render_sql, sql_literal
from gradebook.operators import batchfn as U
from gradebook.operators import convert as C
from gradebook.operators import games as G
from gradebook.operators import matches as M
from gradebook.operators import prompts as P
from gradebook.operators import verdicts as V
from gradebook.operators.keeplast import keep_last
from gradebook.plans import fixtures as fx
from gradebook.plans.oracle_views import with_views
from gradebook.plans.registry import register
from gradebook.plans.sql_snippets import GAMES, RATING

MODELS = fx.MODELS
ALL_PAIR_ORDER = ["m2", "m0", "m3", "m1"]   # list order, deliberately not lexical
BASELINE = "m0"
SLICE = (3, -7)
N_WORKERS = 7
_MODELS_SQL = "(VALUES " + ", ".join(f"('{m}')" for m in MODELS) + ") AS mm(model)"


def _sql(views, body):
    return with_views(views, body)


def _ustrip_sql(x: str) -> str:
    from gradebook.plans.sql_snippets import ustrip_sql
    return ustrip_sql(x)


# ---------------------------------------------------------------------------
# Conversion
# ---------------------------------------------------------------------------

@register("qa_convert", _sql(["raw_qa"], """
, m AS (SELECT *, coalesce(CASE WHEN instruction = 'nan' THEN NULL ELSE instruction END, '')
                   || coalesce(CASE WHEN input = 'nan' THEN NULL ELSE input END, '') AS q FROM raw_qa),
n AS (SELECT *, row_number() OVER (ORDER BY seq) AS question_id FROM m WHERE length(q) > 0)
SELECT question_id, 'generic' AS category, ops_field, task_type, q AS question,
       sha256(CAST(question_id AS VARCHAR)) AS answer_id, 'expert' AS model_id, output AS answer,
       CAST(0.0 AS DOUBLE) AS tstamp
FROM n""".lstrip()))
def qa_convert(spark, sf):
    c = C.convert_raw_qa(fx.raw_qa(spark, sf))
    return c.select("question_id", "category", "ops_field", "task_type", F.get("question", 0).alias("question"),
                    "answer_id", "model_id", F.get("model_answer", 0).alias("answer"), "tstamp")


@register("question_slice", _sql(["questions"], f"""
, p AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS total FROM questions)
SELECT question_id, category, CAST(len(question) AS INTEGER) AS n_turns, question[1] AS first_turn
FROM p WHERE pos >= {SLICE[0]} AND pos < total + ({SLICE[1]})""".lstrip()))
def question_slice(spark, sf):
    s = C.python_slice(fx.questions(spark, sf), "seq", *SLICE)
    return s.select("question_id", "category", F.size("question").alias("n_turns"),
                    F.get("question", 0).alias("first_turn"))


@register("answers_keep_last", _sql(["answer_log"], """
SELECT question_id, model, max(seq) AS seq, arg_max(model_answer[1], seq) AS answer
FROM answer_log GROUP BY question_id, model"""))
def answers_keep_last(spark, sf):
    k = keep_last(fx.answer_log(spark, sf), ["question_id", "model"])
    return k.select("question_id", "model", "seq", F.get("model_answer", 0).alias("answer"))


_TEMP_CASE = "CASE category " + " ".join(
    f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in fixed.TEMPERATURE_CONFIG.items()) + \
    f" ELSE CAST({fixed.DEFAULT_TEMPERATURE} AS DOUBLE) END"


@register("category_temperature", _sql(["questions"], f"""
SELECT question_id, category, {_TEMP_CASE} AS temperature, ({_TEMP_CASE}) >= 1e-4 AS do_sample
FROM questions"""))
def category_temperature(spark, sf):
    q = fx.questions(spark, sf)
    t = C.temperature("category")
    return q.select("question_id", "category", t.alias("temperature"), C.do_sample(t).alias("do_sample"))


@register("turn_rows", _sql(["questions"], """
SELECT question_id, CAST(unnest(range(1, len(question) + 1)) AS INTEGER) AS turn, unnest(question) AS text
FROM questions"""))
def turn_rows(spark, sf):
    return C.turn_rows(fx.questions(spark, sf))


@register("turn_routing", _sql(["questions"], """
SELECT question_id, CAST(len(question) AS INTEGER) AS n_turns,
  CASE WHEN len(question) > 1 THEN 'multi-turn' ELSE 'single-turn' END AS route,
  CASE WHEN len(question) > 1 THEN 'pair-v2-multi-turn' ELSE 'pair-v2' END AS pair_prompt,
  CASE WHEN len(question) > 1 THEN 'pair-ref-v1-multi-turn' ELSE 'pair-ref-v1' END AS pair_prompt_ref,
  CASE WHEN len(question) > 1 THEN 'single-v1-multi-turn' ELSE 'single-v1' END AS single_prompt,
  CASE WHEN len(question) > 1 THEN 'single-ref-v1-multi-turn' ELSE 'single-ref-v1' END AS single_prompt_ref
FROM questions WHERE len(question) >= 1"""))
def turn_routing(spark, sf):
    q = fx.questions(spark, sf).select("question_id", F.size("question").alias("n_turns")).filter("n_turns >= 1")
    n = F.col("n_turns")
    return q.select(
        "question_id", "n_turns",
        F.when(n > 1, F.lit("multi-turn")).otherwise(F.lit("single-turn")).alias("route"),
        M.judge_route(n, False, "pair").alias("pair_prompt"),
        M.judge_route(n, True, "pair").alias("pair_prompt_ref"),
        M.judge_route(n, False, "single").alias("single_prompt"),
        M.judge_route(n, True, "single").alias("single_prompt_ref"))


@register("stop_cut", _sql(["answer_log"], f"""
SELECT seq, model, question_id,
  {_ustrip_sql(f"CASE WHEN strpos(model_answer[1], '{fx.STOP_MARKER}') > 0 THEN substr(model_answer[1], 1, strpos(model_answer[1], '{fx.STOP_MARKER}') - 1) ELSE model_answer[1] END")} AS answer
FROM answer_log"""))
def stop_cut(spark, sf):
    a = fx.answer_log(spark, sf)
    return a.select("seq", "model", "question_id", C.stop_cut(F.get("model_answer", 0), fx.STOP_MARKER).alias("answer"))


@register("chunk_assign", _sql(["questions"], f"""
, p AS (SELECT question_id, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS total FROM questions)
SELECT question_id, CAST(pos // (total // {N_WORKERS}) AS BIGINT) AS chunk FROM p""".lstrip()))
def chunk_assign(spark, sf):
    return C.chunk_assign(fx.questions(spark, sf).select("question_id", "seq"), "seq", N_WORKERS).select(
        "question_id", "chunk")


# ---------------------------------------------------------------------------
# Matches (J1-J7)
# ---------------------------------------------------------------------------

_KL = """kl AS (SELECT question_id, model, arg_max(model_answer, seq) AS model_answer
            FROM answer_log GROUP BY question_id, model)"""


def _answers(spark, sf):
    return keep_last(fx.answer_log(spark, sf), ["question_id", "model"])


@register("missing_answers", _sql(["questions", "answer_log"], f"""
SELECT q.question_id, mm.model FROM questions q, {_MODELS_SQL}
WHERE NOT EXISTS (SELECT 1 FROM answer_log a WHERE a.question_id = q.question_id AND a.model = mm.model)"""))
def missing_answers(spark, sf):
    return M.missing_answers(fx.questions(spark, sf), fx.answer_log(spark, sf), MODELS).select("question_id", "model")


@register("missing_references", _sql(["questions", "reference_answers"], f"""
SELECT question_id FROM questions
WHERE category IN ({", ".join(sql_literal(c) for c in fixed.NEED_REF_CATS)})
  AND question_id NOT IN (SELECT question_id FROM reference_answers)"""))
def missing_references(spark, sf):
    return M.missing_references(fx.questions(spark, sf), fx.reference_answers(spark, sf))


@register("matches_single", _sql(["questions", "answer_log", "reference_answers"], f"""
, {_KL}
SELECT q.question_id, kl.model, CAST(len(q.question) AS INTEGER) AS n_turns,
       CASE WHEN len(q.question) > 1 THEN 'single-ref-v1-multi-turn' ELSE 'single-ref-v1' END AS judge_prompt,
       kl.model_answer[1] AS answer_1, r.model_answer IS NOT NULL AS has_ref
FROM questions q JOIN kl ON q.question_id = kl.question_id
LEFT JOIN reference_answers r ON q.question_id = r.question_id
WHERE kl.model IN ({", ".join(sql_literal(m) for m in MODELS)})""".lstrip()))
def matches_single(spark, sf):
    m = M.single_matches(fx.questions(spark, sf), _answers(spark, sf), MODELS, fx.reference_answers(spark, sf))
    return m.select("question_id", "model", "n_turns", "judge_prompt", F.get("answer", 0).alias("answer_1"),
                    F.col("ref_answer").isNotNull().alias("has_ref"))


def _pairs_sql(pairs: list[tuple[str, str]], prompt_1: str, prompt_mt: str, extra: str = "") -> str:
    vals = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""
, {_KL},
pl AS (SELECT * FROM (VALUES {vals}) AS t(model_1, model_2)),
pm AS (
  SELECT q.question_id, q.question, CAST(len(q.question) AS INTEGER) AS n_turns, pl.model_1, pl.model_2,
         a1.model_answer AS answer_1, a2.model_answer AS answer_2, r.model_answer AS ref_answer,
         CASE WHEN len(q.question) > 1 THEN '{prompt_mt}' ELSE '{prompt_1}' END AS judge_prompt
  FROM pl JOIN kl a1 ON a1.model = pl.model_1
          JOIN kl a2 ON a2.model = pl.model_2 AND a2.question_id = a1.question_id
          JOIN questions q ON q.question_id = a1.question_id
          LEFT JOIN reference_answers r ON r.question_id = q.question_id)
{extra}""".lstrip()


@register("matches_baseline", _sql(["questions", "answer_log", "reference_answers"], _pairs_sql(
    [(m, BASELINE) for m in MODELS if m != BASELINE], "pair-v2", "pair-v2-multi-turn",
    "SELECT question_id, model_1, model_2, n_turns, judge_prompt FROM pm")))
def matches_baseline(spark, sf):
    m = M.baseline_matches(fx.questions(spark, sf), _answers(spark, sf), MODELS, BASELINE)
    return m.select("question_id", "model_1", "model_2", "n_turns", "judge_prompt")


_AP = [(a, b) for _, a, b in M.model_pairs(ALL_PAIR_ORDER)]


@register("matches_all_pairs", _sql(["questions", "answer_log", "reference_answers"], _pairs_sql(
    _AP, "pair-v2", "pair-v2-multi-turn",
    "SELECT question_id, model_1, model_2, n_turns, judge_prompt, answer_1[1] AS answer_1, answer_2[1] AS answer_2 FROM pm")))
def matches_all_pairs(spark, sf):
    m = M.all_pair_matches(fx.questions(spark, sf), _answers(spark, sf), ALL_PAIR_ORDER)
    return m.select("question_id", "model_1", "model_2", "n_turns", "judge_prompt",
                    F.get("answer_1", 0).alias("answer_1"), F.get("answer_2", 0).alias("answer_2"))


@register("match_stats", _sql(["questions", "answer_log", "reference_answers"], _pairs_sql(
    _AP, "pair-v2", "pair-v2-multi-turn",
    f"""SELECT 'pairwise-all' AS mode, 'gpt-4' AS judge, CAST(NULL AS VARCHAR) AS baseline,
       '{",".join(ALL_PAIR_ORDER)}' AS model_list,
       (SELECT count(*) FROM questions) AS total_num_questions, (SELECT count(*) FROM pm) AS total_num_matches""")))
def match_stats(spark, sf):
    q = fx.questions(spark, sf)
    m = M.all_pair_matches(q, _answers(spark, sf), ALL_PAIR_ORDER)
    return M.match_stats(m, q, "pairwise-all", "gpt-4", None, ALL_PAIR_ORDER)


# ---------------------------------------------------------------------------
# Judge prompts
# ---------------------------------------------------------------------------

_CAT = JP.as_dict()


def _case_sql(names: list[str], fields: dict[str, str]) -> str:
    parts = [f"WHEN {sql_literal(n)} THEN {render_sql(_CAT[n]['prompt_template'], fields)}" for n in names]
    return "CASE judge_prompt " + " ".join(parts) + " END"


_SINGLE_FIELDS = {"question": "question[1]", "question_1": "question[1]", "question_2": "question[2]",
                  "answer": "answer[1]", "answer_1": "answer[1]", "answer_2": "answer[2]",
                  "ref_answer_1": "ref_answer[1]", "ref_answer_2": "ref_answer[2]"}


def _pair_fields(a: str, b: str) -> dict[str, str]:
    return {"question": "question[1]", "question_1": "question[1]", "question_2": "question[2]",
            "answer_a": f"{a}[1]", "answer_b": f"{b}[1]", "answer_a_1": f"{a}[1]", "answer_a_2": f"{a}[2]",
            "answer_b_1": f"{b}[1]", "answer_b_2": f"{b}[2]",
            "ref_answer_1": "ref_answer[1]", "ref_answer_2": "ref_answer[2]"}


_SM = """sm AS (
  SELECT q.question_id, q.question, CAST(len(q.question) AS INTEGER) AS n_turns, kl.model,
         kl.model_answer AS answer, r.model_answer AS ref_answer,
         CASE WHEN len(q.question) > 1 THEN '{mt}' ELSE '{one}' END AS judge_prompt
  FROM questions q JOIN kl ON q.question_id = kl.question_id
  LEFT JOIN reference_answers r ON q.question_id = r.question_id
  WHERE kl.model IN ({models}))"""


@register("judge_prompt_single", _sql(["questions", "answer_log", "reference_answers"], f"""
, {_KL}, {_SM.format(mt="single-v1-multi-turn", one="single-v1", models=", ".join(sql_literal(m) for m in MODELS))}
SELECT question_id, model, judge_prompt, {_case_sql(["single-v1", "single-v1-multi-turn"], _SINGLE_FIELDS)} AS user_prompt
FROM sm""".lstrip()))
def judge_prompt_single(spark, sf):
    m = M.single_matches(fx.questions(spark, sf), _answers(spark, sf), MODELS)
    return P.single_judge_prompts(m, _CAT, M.route_names(False, "single")).select(
        "question_id", "model", "judge_prompt", "user_prompt")


@register("judge_prompt_multiturn", _sql(["questions", "answer_log", "reference_answers"], f"""
, {_KL}, {_SM.format(mt="single-ref-v1-multi-turn", one="single-ref-v1", models=", ".join(sql_literal(m) for m in MODELS))}
SELECT question_id, model, judge_prompt,
       {_case_sql(["single-ref-v1", "single-ref-v1-multi-turn"], _SINGLE_FIELDS)} AS user_prompt,
       {sql_literal(_CAT["single-ref-v1-multi-turn"]["system_prompt"])} AS system_prompt
FROM sm WHERE n_turns > 1""".lstrip()))
def judge_prompt_multiturn(spark, sf):
    m = M.single_matches(fx.questions(spark, sf), _answers(spark, sf), MODELS, fx.reference_answers(spark, sf))
    m = m.filter(F.col("n_turns") > 1)
    return P.single_judge_prompts(m, _CAT, M.route_names(True, "single")).select(
        "question_id", "model", "judge_prompt", "user_prompt", "system_prompt")


_PAIR_JUDGE = "claude-v1"


def _fold_sql(user: str) -> str:
    sysc = "CASE judge_prompt " + " ".join(
        f"WHEN {sql_literal(n)} THEN {sql_literal(_CAT[n]['system_prompt'])}"
        for n in ["pair-ref-v1", "pair-ref-v1-multi-turn"]) + " END"
    return (f"CASE WHEN ({sysc}) <> {sql_literal(fixed.STOCK_SYSTEM_PROMPT)} "
            f"THEN '[Instruction]' || chr(10) || ({sysc}) || chr(10) || chr(10) || ({user}) ELSE ({user}) END")


_PNAMES = ["pair-ref-v1", "pair-ref-v1-multi-turn"]


@register("judge_prompt_pair", _sql(["questions", "answer_log", "reference_answers"], _pairs_sql(
    _AP, "pair-ref-v1", "pair-ref-v1-multi-turn",
    f"""SELECT question_id, model_1, model_2, judge_prompt,
       {_fold_sql(_case_sql(_PNAMES, _pair_fields("answer_1", "answer_2")))} AS g1_user_prompt,
       {_fold_sql(_case_sql(_PNAMES, _pair_fields("answer_2", "answer_1")))} AS g2_user_prompt
FROM pm""")))
def judge_prompt_pair(spark, sf):
    m = M.all_pair_matches(fx.questions(spark, sf), _answers(spark, sf), ALL_PAIR_ORDER,
                           fx.reference_answers(spark, sf))
    return P.pair_judge_prompts(m, _CAT, _PAIR_JUDGE, M.route_names(True, "pair")).select(
        "question_id", "model_1", "model_2", "judge_prompt", "g1_user_prompt", "g2_user_prompt")


# ---------------------------------------------------------------------------
# Offline judge over all-pairs matches
# ---------------------------------------------------------------------------

def _judge_sql(a: str, b: str) -> str:
    return (f"CASE WHEN length(coalesce({a}, '')) > length(coalesce({b}, '')) THEN 'Assistant A is more complete. [[A]]' "
            f"WHEN length(coalesce({a}, '')) < length(coalesce({b}, '')) THEN 'Assistant B is more complete. [[B]]' "
            f"ELSE 'Both answers are equally complete. [[C]]' END")


@register("judge_map", _sql(["questions", "answer_log", "reference_answers"], _pairs_sql(
    _AP, "pair-v2", "pair-v2-multi-turn",
    f""", j AS (SELECT question_id, model_1, model_2,
         {_judge_sql("answer_1[1]", "answer_2[1]")} AS g1_judgment,
         {_judge_sql("answer_2[1]", "answer_1[1]")} AS g2_judgment FROM pm)
SELECT question_id, model_1, model_2, g1_judgment, g2_judgment,
  CASE WHEN contains(g1_judgment, '[[A]]') THEN 'model_1' WHEN contains(g1_judgment, '[[B]]') THEN 'model_2'
       WHEN contains(g1_judgment, '[[C]]') THEN 'tie' ELSE 'error' END AS g1_winner,
  CASE WHEN contains(g2_judgment, '[[A]]') THEN 'model_2' WHEN contains(g2_judgment, '[[B]]') THEN 'model_1'
       WHEN contains(g2_judgment, '[[C]]') THEN 'tie' ELSE 'error' END AS g2_winner,
  CAST(NULL AS VARCHAR) AS error
FROM j""")))
def judge_map(spark, sf):
    m = M.all_pair_matches(fx.questions(spark, sf), _answers(spark, sf), ALL_PAIR_ORDER)
    m = m.select("question_id", "model_1", "model_2",
                 F.get("answer_1", 0).alias("a1"), F.get("answer_2", 0).alias("a2"))
    both = U.call_model_multi(m, U.length_judge_factory,
                              [(["a1", "a2"], "g1_judgment"), (["a2", "a1"], "g2_judgment")])
    both = both.withColumn("error", F.coalesce("g1_judgment_error", "g2_judgment_error"))
    out = V.with_game_winners(both)
    return out.select("question_id", "model_1", "model_2", "g1_judgment", "g2_judgment",
                      "g1_winner", "g2_winner", "error")


# ---------------------------------------------------------------------------
# Games (W1-W3, Q1, Q2, V5)
# ---------------------------------------------------------------------------

_CANON = f"""{GAMES},
w AS (SELECT *, CASE WHEN g1_winner = g2_winner THEN g1_winner ELSE 'inconsistent' END AS winner FROM games),
a AS (SELECT judge_model, judge_prompt, question_id, model_1, model_2,
             arg_max(winner, seq) AS winner, arg_max(g1_judgment, seq) AS g1j,
             arg_max(g2_judgment, seq) AS g2j, min(seq) AS first_seen
      FROM w GROUP BY judge_model, judge_prompt, question_id, model_1, model_2),
c AS (SELECT judge_model, judge_prompt, question_id, first_seen,
             CASE WHEN model_1 < model_2 THEN model_1 ELSE model_2 END AS m1,
             CASE WHEN model_1 < model_2 THEN model_2 ELSE model_1 END AS m2,
             CASE WHEN model_1 < model_2 THEN winner WHEN winner = 'model_1' THEN 'model_2'
                  WHEN winner = 'model_2' THEN 'model_1' ELSE winner END AS winner,
             CASE WHEN model_1 < model_2 THEN g1j ELSE g2j END AS g1_judgment,
             CASE WHEN model_1 < model_2 THEN g2j ELSE g1j END AS g2_judgment FROM a),
canon AS (SELECT judge_model, judge_prompt, question_id, m1 AS model_1, m2 AS model_2,
                 arg_max(winner, first_seen) AS winner, arg_max(g1_judgment, first_seen) AS g1_judgment,
                 arg_max(g2_judgment, first_seen) AS g2_judgment
          FROM c GROUP BY judge_model, judge_prompt, question_id, m1, m2)"""


def _canon(spark, sf):
    return G.canonical_games(V.with_game_winners(fx.pair_log(spark, sf)))


@register("games_canonical", _sql(["pair_log"], f"""
, {_CANON}
SELECT * FROM canon""".lstrip()))
def games_canonical(spark, sf):
    return _canon(spark, sf)


_DJ_PROMPT = (f"CASE WHEN category IN ({', '.join(map(sql_literal, fixed.NEED_REF_CATS))}) THEN 'pair-math-v1' ELSE 'pair-v2' END"
              " || CASE WHEN n_turns > 1 THEN '-multi-turn' ELSE '' END")


@register("default_judge", _sql(["pair_log", "question_labels"], f"""
, {_CANON},
qp AS (SELECT question_id, category, n_turns, {_DJ_PROMPT} AS judge_prompt FROM question_labels),
qj AS (SELECT qp.*, CASE WHEN EXISTS (SELECT 1 FROM canon c WHERE c.judge_model = 'gpt-4'
                                       AND c.judge_prompt = qp.judge_prompt)
                    THEN 'gpt-4' ELSE 'gpt-3.5-turbo' END AS judge_model FROM qp),
cnt AS (SELECT judge_model, judge_prompt, question_id, count(*) AS n FROM canon GROUP BY ALL)
SELECT qj.question_id, qj.category, qj.n_turns, qj.judge_model, qj.judge_prompt,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n_games
FROM qj LEFT JOIN cnt ON cnt.judge_model = qj.judge_model AND cnt.judge_prompt = qj.judge_prompt
                     AND cnt.question_id = qj.question_id""".lstrip()))
def default_judge(spark, sf):
    return G.resolve_default_judge(fx.question_labels(spark, sf), _canon(spark, sf))


_EXPL_JUDGE = ("gpt-4", "pair-v2")


def _requests(pl):
    fwd = pl.select("question_id", "model_1", "model_2")
    rev = pl.select("question_id", F.col("model_2").alias("model_1"), F.col("model_1").alias("model_2"))
    return fwd.union(rev).distinct()


_EXPL_SQL = render_sql(fixed.EXPLANATION_FORMAT, {
    "model_1": "r.model_1", "model_2": "r.model_2",
    "g1_judgment": "CASE WHEN r.model_1 < r.model_2 THEN c.g1_judgment ELSE c.g2_judgment END",
    "g2_judgment": "CASE WHEN r.model_1 < r.model_2 THEN c.g2_judgment ELSE c.g1_judgment END"})


@register("explanations", _sql(["pair_log"], f"""
, {_CANON},
r AS (SELECT question_id, model_1, model_2 FROM pair_log
      UNION SELECT question_id, model_2, model_1 FROM pair_log),
cx AS (SELECT * FROM canon WHERE judge_model = '{_EXPL_JUDGE[0]}' AND judge_prompt = '{_EXPL_JUDGE[1]}')
SELECT r.question_id, r.model_1, r.model_2,
       CASE WHEN c.question_id IS NULL THEN 'N/A' ELSE {_EXPL_SQL} END AS explanation
FROM r LEFT JOIN cx c ON c.question_id = r.question_id
  AND c.model_1 = least(r.model_1, r.model_2) AND c.model_2 = greatest(r.model_1, r.model_2)""".lstrip()))
def explanations(spark, sf):
    pl = fx.pair_log(spark, sf)
    return G.explanations(_requests(pl), _canon(spark, sf), *_EXPL_JUDGE)


SINGLE_MODELS = ["m0", "m1", "m2", "m3", "m4", "m5"]


@register("pair_from_single", _sql(["single_log"], f"""
, sc AS (SELECT question_id, judge_prompt, turn, model, arg_max({RATING}, seq) AS score FROM single_log
         GROUP BY question_id, judge_prompt, turn, model),
pl AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for _, a, b in M.model_pairs(SINGLE_MODELS))}) AS t(model_1, model_2)),
pr AS (SELECT s1.question_id, s1.judge_prompt, s1.turn, pl.model_1, pl.model_2, s1.score AS m1_score, s2.score AS m2_score
       FROM pl JOIN sc s1 ON s1.model = pl.model_1
       JOIN sc s2 ON s2.model = pl.model_2 AND s2.question_id = s1.question_id AND s2.judge_prompt = s1.judge_prompt AND s2.turn = s1.turn),
w AS (SELECT *, CASE WHEN abs(m1_score - m2_score) <= CAST(0.1 AS DOUBLE) THEN 'tie'
                     WHEN m1_score > m2_score THEN 'model_1' ELSE 'model_2' END AS g1_winner FROM pr)
SELECT *, g1_winner AS g2_winner FROM w""".lstrip()))
def pair_from_single(spark, sf):
    from gradebook.operators.keeplast import keep_last
    s = keep_last(fx.single_log(spark, sf).select("question_id", "judge_prompt", "turn", "model", "judgment", "seq"),
                  ["question_id", "judge_prompt", "turn", "model"])
    return V.pairs_from_single(V.with_rating(s), [(a, b) for _, a, b in M.model_pairs(SINGLE_MODELS)])


@register("answers_compacted", _sql(["answer_log"], """
SELECT model, question_id, max(seq) AS seq, arg_max(model_answer[2], seq) AS follow_up
FROM answer_log GROUP BY model, question_id"""))
def answers_compacted(spark, sf):
    from gradebook.operators.keeplast import compact_log
    c = compact_log(fx.answer_log(spark, sf), ["model", "question_id"])
    return c.select("model", "question_id", "seq", F.get("model_answer", 1).alias("follow_up"))


_GEN_TEMP = _TEMP_CASE


@register("answer_generation", _sql(["questions"], f"""
SELECT question_id, 'echo' AS model_id, CAST(len(question) AS INTEGER) AS n_answers,
       {_ustrip_sql("'t=' || CAST(" + _GEN_TEMP + " AS VARCHAR) || ' n=1 last=' || question[1]")} AS answer_1,
       {_ustrip_sql("'t=' || CAST(" + _GEN_TEMP + " AS VARCHAR) || ' n=' || CAST(2 * len(question) - 1 AS VARCHAR) || ' last=' || question[len(question)]")} AS answer_last
FROM questions"""))
def answer_generation(spark, sf):
    g = U.generate_answers(fx.questions(spark, sf), U.echo_generator_factory(fx.STOP_MARKER), "echo",
                           stop=fx.STOP_MARKER, retry_sleep=0.0)
    return g.select("question_id", "model_id", F.size("model_answer").alias("n_answers"),
                    F.get("model_answer", 0).alias("answer_1"),
                    F.element_at("model_answer", -1).alias("answer_last"))


@register("answer_turns", _sql(["questions"], f"""
, t AS (SELECT question_id, category, question, unnest(range(len(question))) AS turn FROM questions)
SELECT question_id, 'echo' AS model_id, CAST(turn AS INTEGER) AS turn,
       {_ustrip_sql("'t=' || CAST(" + _GEN_TEMP + " AS VARCHAR) || ' n=' || CAST(2 * turn + 1 AS VARCHAR) || ' last=' || question[turn + 1]")} AS answer
FROM t""".lstrip()))
def answer_turns(spark, sf):
    """Every turn of every question through the stored generation job."""
    import uuid

    from gradebook.plans.flows import generate_stored
    from gradebook.session import checkpoint_dir, single_machine

    path = f"{checkpoint_dir(spark, create_local_if_unset=single_machine(spark)).rstrip('/')}/tables/answer-turns-{uuid.uuid4().hex}"
    g = generate_stored(fx.questions(spark, sf), U.echo_generator_factory(fx.STOP_MARKER), "echo", path, stop=fx.STOP_MARKER, retry_sleep=0.0)
    return g.select("question_id", "model_id", F.posexplode("model_answer").alias("turn", "answer"))
