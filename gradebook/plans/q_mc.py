"""Multiple-choice queries (E1-E4, A10-A14, X1, F1-F5) and token accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradebook import judge_prompts as JP
from gradebook.functions.extract import mc_correct, mc_letter
from gradebook.functions.templates import sql_literal
from gradebook.operators import boards as B
from gradebook.operators import prompts as P
from gradebook.operators import tokens as T
from gradebook.operators.batchfn import pending
from gradebook.plans import fixtures as fx
from gradebook.plans.oracle_views import with_views
from gradebook.plans.registry import register
from gradebook.plans.sql_snippets import mc_letter_sql, ustrip_sql

NTRAIN = 5
PLANNED_RUNS = fx.MC_RUNS + [("mB", 0, False)]
RUN_LABELS = ["mA_ntrain=0_cot=False", "mA_ntrain=5_cot=False", "mB_ntrain=5_cot=True"]


@register("mc_letter", with_views(["mc_outputs"], f"""
SELECT run, id, model_output, {mc_letter_sql(ustrip_sql("model_output"))} AS letter FROM mc_outputs"""))
def q_mc_letter(spark, sf):
    o = fx.mc_outputs(spark, sf)
    return o.select("run", "id", "model_output", mc_letter("model_output").alias("letter"))


@register("mc_correct", with_views(["mc_outputs"], f"""
SELECT run, id, answer,
       CAST(coalesce(lower({mc_letter_sql(ustrip_sql("model_output"))}) = lower(answer), FALSE) AS INTEGER) AS correct
FROM mc_outputs"""))
def q_mc_correct(spark, sf):
    o = fx.mc_outputs(spark, sf)
    return o.select("run", "id", "answer", mc_correct("model_output", "answer").alias("correct"))


_ACC = """cat AS (SELECT model, ntrain, cot, category, avg(correct) AS acc FROM mc_results
             GROUP BY model, ntrain, cot, category),
acc AS (SELECT model, ntrain, cot, category, round_even(acc * 100.0, 2) AS acc FROM cat
        UNION ALL
        SELECT model, ntrain, cot, 'ALL' AS category, round_even(round(avg(acc), 12) * 100.0, 2) AS acc
        FROM cat GROUP BY model, ntrain, cot)"""


@register("mc_accuracy", with_views(["mc_results"], f"""
, {_ACC}
SELECT * FROM acc""".lstrip()))
def q_mc_accuracy(spark, sf):
    return B.mc_accuracy(fx.mc_results(spark, sf), macro_places=12)


@register("mc_subject_accuracy", with_views(["mc_results"], """
SELECT model, ntrain, cot, subject, CAST(sum(correct) AS BIGINT) AS n_correct, count(*) AS n,
       round_even(avg(correct) * 100.0, 2) AS acc
FROM mc_results GROUP BY model, ntrain, cot, subject"""))
def q_mc_subject_accuracy(spark, sf):
    return B.subject_accuracy(fx.mc_results(spark, sf))


@register("mc_config_board", with_views(["mc_results"], f"""
, {_ACC}
SELECT * FROM acc WHERE ntrain = 5 AND NOT cot""".lstrip()))
def q_mc_config_board(spark, sf):
    return B.runs_with_config(B.mc_accuracy(fx.mc_results(spark, sf), macro_places=12), 5, False)


def _label_sql(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return (f"{a}model || '_ntrain=' || CAST({a}ntrain AS VARCHAR) || '_cot=' || "
            f"CASE WHEN {a}cot THEN 'True' ELSE 'False' END")


@register("mc_runs_wide", with_views(["mc_results"], f"""
, {_ACC},
lab AS (SELECT {_label_sql()} AS run, category, acc FROM acc)
SELECT category, {", ".join(f'max(CASE WHEN run = {sql_literal(r)} THEN acc END) AS "{r}"' for r in RUN_LABELS)}
FROM lab GROUP BY category""".lstrip()))
def q_mc_runs_wide(spark, sf):
    return B.mc_runs_wide(B.mc_accuracy(fx.mc_results(spark, sf), macro_places=12), RUN_LABELS)


@register("mc_run_labels", with_views(["mc_runs"], f"""
SELECT model, ntrain, cot, {_label_sql()} AS run,
       regexp_replace({_label_sql()}, '(_[^_]*){{2}}$', '') AS legend FROM mc_runs"""))
def q_mc_run_labels(spark, sf):
    # The run table is derived from the result rows, so it grows with them.
    r = fx.mc_results(spark, sf).select("model", "ntrain", "cot").distinct()
    lab = B.run_label(F.col("model"), F.col("ntrain"), F.col("cot"))
    return r.select("model", "ntrain", "cot", lab.alias("run"), B.trim_run_label(lab).alias("legend"))


_PLANNED_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS model, {n} AS ntrain, {'TRUE' if c else 'FALSE'} AS cot" for m, n, c in PLANNED_RUNS)


@register("mc_todo", with_views(["mc_results"], f"""
, planned AS ({_PLANNED_SQL}),
subj AS (SELECT subject, count(*) AS n_questions FROM mc_questions GROUP BY subject),
work AS (SELECT p.model, p.ntrain, p.cot, s.subject, s.n_questions FROM planned p, subj s)
SELECT * FROM work w WHERE NOT EXISTS (
  SELECT 1 FROM mc_results r WHERE r.model = w.model AND r.ntrain = w.ntrain AND r.cot = w.cot
                               AND r.subject = w.subject)""".lstrip()))
def q_mc_todo(spark, sf):
    subj = fx.mc_questions(spark, sf).groupBy("subject").agg(F.count("*").alias("n_questions"))
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).alias("ntrain"), F.lit(c).alias("cot"))
                               for m, n, c in PLANNED_RUNS]))
    work = subj.select(runs.alias("r"), "subject", "n_questions").select("r.*", "subject", "n_questions")
    return pending(work, fx.mc_results(spark, sf), ["model", "ntrain", "cot", "subject"])


def _choices_sql(a: str = "") -> str:
    p = f"{a}." if a else ""
    return (f"'A.' || coalesce({p}\"A\", '') || chr(10) || 'B.' || coalesce({p}\"B\", '') || chr(10) || "
            f"'C.' || coalesce({p}\"C\", '') || chr(10) || 'D.' || coalesce({p}\"D\", '') || chr(10)")


_Q = sql_literal(P.QUESTION_LABEL)
_A = sql_literal(P.ANSWER_LABEL)


@register("zeroshot_prompt", with_views(["mc_questions"], f"""
SELECT id, subject, {sql_literal(P.ZERO_SHOT_HEADER)} || {_Q} || question || chr(10) || {_choices_sql()} || {_A} AS input,
       answer AS output
FROM mc_questions"""))
def q_zeroshot(spark, sf):
    return P.zero_shot(fx.mc_questions(spark, sf)).select("id", "subject", "input", "output")


@register("fewshot_prompt", with_views(["mc_questions", "mc_shots"], f"""
, sh AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY id) AS rn,
               chr(10) || {_Q} || question || chr(10) || {_choices_sql()} || {_A} || answer AS t FROM mc_shots),
px AS (SELECT subject, {sql_literal(P.FEW_SHOT_HEADER)} || string_agg(t, '' ORDER BY rn) AS prefix
       FROM sh WHERE rn <= {NTRAIN} GROUP BY subject)
SELECT q.id, q.subject,
       coalesce(px.prefix, {sql_literal(P.FEW_SHOT_HEADER)}) || chr(10) || {_Q} || q.question || chr(10)
         || {_choices_sql("q")} || {_A} AS input,
       q.answer AS output
FROM mc_questions q LEFT JOIN px ON q.subject = px.subject""".lstrip()))
def q_fewshot(spark, sf):
    return P.few_shot(fx.mc_questions(spark, sf), fx.mc_shots(spark, sf), NTRAIN).select(
        "id", "subject", "input", "output")


@register("chat_shots", with_views(["mc_shots"], f"""
, sh AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY id) AS shot_pos,
               question || chr(10) || {_choices_sql()} AS input, answer AS output FROM mc_shots)
SELECT * FROM sh WHERE shot_pos <= {NTRAIN}""".lstrip()))
def q_chat_shots(spark, sf):
    s = P.chat_shots(fx.mc_shots(spark, sf), NTRAIN)
    return s.select("subject", F.col("shot_pos").cast("long").alias("shot_pos"), "input", "output")


@register("chat_inputs", with_views(["mc_questions"], f"""
SELECT id, subject, question || chr(10) || {_choices_sql()} AS input, answer AS output FROM mc_questions"""))
def q_chat_inputs(spark, sf):
    return P.chat_inputs(fx.mc_questions(spark, sf), ntrain=NTRAIN).select("id", "subject", "input", "output")


@register("subject_counts", with_views(["mc_questions"], """
SELECT subject, count(*) AS n FROM mc_questions GROUP BY subject"""))
def q_subject_counts(spark, sf):
    return fx.mc_questions(spark, sf).groupBy("subject").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Token accounting
# ---------------------------------------------------------------------------

_CAT = JP.as_dict()
_TOK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _tok_sql(x: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({x}, '{_TOK}')), 0) AS BIGINT)"


_SYS_CASE = "CASE judge_prompt " + " ".join(
    f"WHEN {sql_literal(n)} THEN {sql_literal(t['system_prompt'])}" for n, t in _CAT.items()) + " END"


def _detail_sql() -> str:
    inp = lambda u: f"(3 + 3 + 3 + {_tok_sql(sql_literal('system'))} + {_tok_sql('(' + _SYS_CASE + ')')} + {_tok_sql(sql_literal('user'))} + {_tok_sql(u)})"
    out = lambda j: f"(3 + 3 + {_tok_sql(sql_literal('assistant'))} + {_tok_sql(j)})"
    return f"""detail AS (
  SELECT bench, 'single' AS mode, question_id, model AS model_key, 0 AS game, judge_model,
         {inp('user_prompt')} AS input_tokens, {out('judgment')} AS output_tokens FROM single_log
  UNION ALL
  SELECT bench, 'pair', question_id, least(model_1, model_2) || ',' || greatest(model_1, model_2), 1,
         judge_model, {inp('g1_user_prompt')}, {out('g1_judgment')} FROM pair_log
  UNION ALL
  SELECT bench, 'pair', question_id, least(model_1, model_2) || ',' || greatest(model_1, model_2), 2,
         judge_model, {inp('g2_user_prompt')}, {out('g2_judgment')} FROM pair_log)"""


def _detail(spark, sf):
    return T.token_detail(fx.single_log(spark, sf), fx.pair_log(spark, sf), _CAT, judge_model="gpt-3.5-turbo")


@register("token_detail", with_views(["single_log", "pair_log"], f"""
, {_detail_sql()}
SELECT * FROM detail""".lstrip()))
def q_token_detail(spark, sf):
    return _detail(spark, sf)


@register("token_totals", with_views(["single_log", "pair_log"], f"""
, {_detail_sql()}
SELECT bench, mode, model_key, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS output_tokens, count(*) AS n
FROM detail GROUP BY bench, mode, model_key""".lstrip()))
def q_token_totals(spark, sf):
    return T.token_totals(_detail(spark, sf))
