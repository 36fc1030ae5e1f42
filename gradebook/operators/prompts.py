"""Prompt rendering over tables (P1-P5 judge prompts, F1-F5 multiple choice).

Templates are compiled once on the driver into Column expressions; rendering is a
projection (no Python per row).  Few-shot prefixes are aggregated once per subject
(bounded by the shot count) and joined back by subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook import fixed
from gradebook.functions.templates import option_block, render, template_fields


def _g(c: str, i: int) -> Column:
    return F.get(F.col(c), i)


def single_bindings(question: str = "question", answer: str = "answer", ref: str = "ref_answer") -> dict:
    """P1 field set for 1-turn and 2-turn single templates (turns past 2 ignored)."""
    return {
        "question": _g(question, 0), "question_1": _g(question, 0), "question_2": _g(question, 1),
        "answer": _g(answer, 0), "answer_1": _g(answer, 0), "answer_2": _g(answer, 1),
        "ref_answer_1": _g(ref, 0), "ref_answer_2": _g(ref, 1),
    }


def pair_bindings(answer_a: str, answer_b: str, question: str = "question", ref: str = "ref_answer") -> dict:
    """P2 field set; game 2 swaps the two answer columns."""
    return {
        "question": _g(question, 0), "question_1": _g(question, 0), "question_2": _g(question, 1),
        "answer_a": _g(answer_a, 0), "answer_b": _g(answer_b, 0),
        "answer_a_1": _g(answer_a, 0), "answer_a_2": _g(answer_a, 1),
        "answer_b_1": _g(answer_b, 0), "answer_b_2": _g(answer_b, 1),
        "ref_answer_1": _g(ref, 0), "ref_answer_2": _g(ref, 1),
    }


def render_by_name(name: Column, catalog: dict[str, dict], bindings: dict, names: list[str] | None = None) -> Column:
    """CASE over template names: each row renders the template it is routed to; a name without a template is an error."""
    expr = None
    for n in names or list(catalog):
        t = catalog[n]["prompt_template"]
        cols = {f: bindings[f] for f in template_fields(t)}
        piece = render(t, cols)
        expr = F.when(name == n, piece) if expr is None else expr.when(name == n, piece)
    return expr.otherwise(F.raise_error(F.concat(F.lit("no judge prompt of this name in the catalog: "), F.coalesce(name, F.lit("null")))).cast("string"))


def system_by_name(name: Column, catalog: dict[str, dict]) -> Column:
    m = F.create_map(*[x for n, t in catalog.items() for x in (F.lit(n), F.lit(t["system_prompt"]))])
    return F.try_element_at(m, name)


def fold_system(judge_model: str, system: Column, user: Column) -> Column:
    """For the completion-style judge family the system text is folded into the
    user prompt, unless it is the stock sentence."""
    if judge_model not in fixed.ANTHROPIC_JUDGES:
        return user
    return F.when(system != F.lit(fixed.STOCK_SYSTEM_PROMPT),
                  F.concat(F.lit("[Instruction]\n"), system, F.lit("\n\n"), user)).otherwise(user)


def single_judge_prompts(matches: DataFrame, catalog: dict[str, dict], names: list[str] | None = None) -> DataFrame:
    """Add ``user_prompt`` and ``system_prompt`` to single matches.

    ``names`` limits the rendering CASE to the template names the matches can
    carry (e.g. the two names of a route); by default every single template.
    """
    b = single_bindings()
    names = names or [n for n, t in catalog.items() if t["type"] == "single"]
    return matches.select("*",
                          render_by_name(F.col("judge_prompt"), catalog, b, names).alias("user_prompt"),
                          system_by_name(F.col("judge_prompt"), catalog).alias("system_prompt"))


def pair_judge_prompts(matches: DataFrame, catalog: dict[str, dict], judge_model: str,
                       names: list[str] | None = None) -> DataFrame:
    """Both position orders rendered in one projection (``names`` as in
    ``single_judge_prompts``)."""
    sys = system_by_name(F.col("judge_prompt"), catalog)
    names = names or [n for n, t in catalog.items() if t["type"] == "pairwise"]
    g1 = render_by_name(F.col("judge_prompt"), catalog, pair_bindings("answer_1", "answer_2"), names)
    g2 = render_by_name(F.col("judge_prompt"), catalog, pair_bindings("answer_2", "answer_1"), names)
    return matches.select("*", sys.alias("system_prompt"),
                          fold_system(judge_model, sys, g1).alias("g1_user_prompt"),
                          fold_system(judge_model, sys, g2).alias("g2_user_prompt"))


# ---------------------------------------------------------------------------
# Multiple choice (own wording; headers are parameters)
# ---------------------------------------------------------------------------

ZERO_SHOT_HEADER = ("You are an assistant sitting an IT-operations exam. The following is a "
                    "single-choice question; pick the correct option.\n")
FEW_SHOT_HEADER = ("You are an assistant sitting an IT-operations exam. The following are "
                   "single-choice questions; pick the correct option.")
QUESTION_LABEL = "Question:\n"
ANSWER_LABEL = "Answer:"


def with_choices(df: DataFrame) -> DataFrame:
    """the option block from columns A-D (verbatim text, null as empty)."""
    return df.withColumn("choices", option_block("A", "B", "C", "D"))


def zero_shot(val: DataFrame, header: str = ZERO_SHOT_HEADER) -> DataFrame:
    """header + question + options + answer cue; output = the answer key."""
    v = with_choices(val)
    return v.select("*", F.concat(F.lit(header), F.lit(QUESTION_LABEL), F.col("question"), F.lit("\n"),
                                  F.col("choices"), F.lit(ANSWER_LABEL)).alias("input"),
                    F.col("answer").alias("output"))


def first_shots(shots: DataFrame, ntrain: int) -> DataFrame:
    """the first ``ntrain`` shots (by id) of each subject, clamped per subject."""
    w = Window.partitionBy("subject").orderBy("id")
    return with_choices(shots).withColumn("shot_pos", F.row_number().over(w)).filter(F.col("shot_pos") <= ntrain)


def check_subjects(val: DataFrame, shots: DataFrame) -> DataFrame:
    """Validation subjects that have no shot file (an error in few-shot mode)."""
    return val.select("subject").distinct().join(shots.select("subject").distinct(), "subject", "left_anti")


def few_shot(val: DataFrame, shots: DataFrame, ntrain: int, header: str = FEW_SHOT_HEADER,
             strict: bool = True) -> DataFrame:
    """per-subject prefix (header + first n shots with answers) + the question."""
    if strict:
        missing = [r["subject"] for r in check_subjects(val, shots).limit(5).collect()]
        if missing:
            raise KeyError(f"no few-shot examples for subjects {missing}")
    s = first_shots(shots, ntrain)
    shot_text = F.concat(F.lit("\n"), F.lit(QUESTION_LABEL), F.col("question"), F.lit("\n"), F.col("choices"),
                         F.lit(ANSWER_LABEL), F.col("answer"))
    prefix = (s.groupBy("subject")
              .agg(F.sort_array(F.collect_list(F.struct("shot_pos", shot_text.alias("t")))).alias("p"))
              .select("subject", F.concat(F.lit(header), F.array_join(F.transform("p", lambda x: x["t"]), ""))
                      .alias("prefix")))
    # One prefix row per subject: AQE broadcasts it from its measured size.
    v = with_choices(val).join(prefix, "subject", "left")
    prefix_col = F.coalesce(F.col("prefix"), F.lit(header))
    inp = F.concat(prefix_col, F.lit("\n"), F.lit(QUESTION_LABEL), F.col("question"), F.lit("\n"),
                   F.col("choices"), F.lit(ANSWER_LABEL))
    return v.select(*[c for c in v.columns if c != "prefix"], inp.alias("input"), F.col("answer").alias("output"))


def chat_inputs(val: DataFrame, header: str = ZERO_SHOT_HEADER, ntrain: int = 0) -> DataFrame:
    """role-style input; with shots the header is left to the chat template."""
    v = with_choices(val)
    body = F.concat(F.col("question"), F.lit("\n"), F.col("choices"))
    inp = F.concat(F.lit(header), body) if ntrain == 0 else body
    return v.select("*", inp.alias("input"), F.col("answer").alias("output"))


def chat_shots(shots: DataFrame, ntrain: int) -> DataFrame:
    """shots kept as (input, output) rows per subject, in order."""
    s = first_shots(shots, ntrain)
    return s.select("subject", "shot_pos", F.concat(F.col("question"), F.lit("\n"), F.col("choices")).alias("input"),
                    F.col("answer").alias("output"))
