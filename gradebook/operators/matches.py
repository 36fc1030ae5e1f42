"""Match making (J1-J7): questions x models x answers -> matches to judge.

Model lists are user parameters (a handful of names), so pair lists are built
on the driver from the list (k(k-1)/2 literals).  Each question's answers are
reduced to a map of at most k entries and the literal pair list is exploded
against it; no theta self-join of the answers and no all-pairs expansion of data
rows happens at run time.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook import fixed


def model_pairs(models: list[str]) -> list[tuple[int, str, str]]:
    """(rank, model_1, model_2) for i < j in list order."""
    return [(r, a, b) for r, (a, b) in enumerate(combinations(models, 2))]


def _models_col(models: list[str]) -> Column:
    return F.explode(F.array(*[F.lit(m) for m in models]))


def expected_grid(questions: DataFrame, models: list[str]) -> DataFrame:
    """Every (question, model) cell that must hold an answer (bounded fan-out)."""
    return questions.select("question_id", _models_col(models).alias("model"))


def missing_answers(questions: DataFrame, answers: DataFrame, models: list[str]) -> DataFrame:
    """All (model, question_id) cells without an answer (not only the first)."""
    have = answers.select("question_id", "model")
    return expected_grid(questions, models).join(have, ["question_id", "model"], "left_anti")


def missing_references(questions: DataFrame, refs: DataFrame) -> DataFrame:
    """J1 (D2 fixed): reference-category questions without a reference answer."""
    need = questions.filter(F.col("category").isin(*fixed.NEED_REF_CATS)).select("question_id")
    return need.join(refs.select("question_id"), "question_id", "left_anti")


def assert_complete(questions: DataFrame, answers: DataFrame, models: list[str]) -> None:
    """Strict mode: raise listing a few misses when any cell is missing."""
    miss = missing_answers(questions, answers, models).limit(5).collect()
    if miss:
        raise ValueError(f"missing model answers, e.g. {[tuple(r) for r in miss]}")


def judge_route(n_turns: Column, with_reference: bool, mode: str) -> Column:
    """Template name by turn class and reference use (math prompts unused)."""
    one, multi = route_names(with_reference, mode)
    return F.when(n_turns > 1, F.lit(multi)).otherwise(F.lit(one))


def route_names(with_reference: bool, mode: str) -> list[str]:
    """The two template names ``judge_route`` can produce (1-turn, multi-turn)."""
    prefix = "single" if mode == "single" else "pair"
    one = f"{prefix}-ref-v1" if with_reference else (f"{prefix}-v1" if mode == "single" else "pair-v2")
    return [one, f"{one}-multi-turn"]


def _questions(questions: DataFrame) -> DataFrame:
    # 1-turn vs multi-turn; questions with no turn drop out.
    return (questions.select("question_id", "category", "question",
                             F.size("question").alias("n_turns"))
            .filter(F.col("n_turns") >= 1))


def _with_refs(m: DataFrame, refs: DataFrame | None) -> DataFrame:
    if refs is None:
        return m.withColumn("ref_answer", F.lit(None).cast("array<string>"))
    r = refs.select("question_id", F.col("model_answer").alias("ref_answer"))
    return m.join(r, "question_id", "left")


def single_matches(questions: DataFrame, answers: DataFrame, models: list[str],
                   refs: DataFrame | None = None) -> DataFrame:
    """One match per (question, model) with an answer; optional reference."""
    q = _questions(questions)
    a = answers.filter(F.col("model").isin(*models)).select(
        "question_id", "model", F.col("model_answer").alias("answer"))
    m = q.join(a, "question_id")
    m = _with_refs(m, refs)
    return m.withColumn("judge_prompt", judge_route(F.col("n_turns"), refs is not None, "single"))


def _pair_matches(questions: DataFrame, answers: DataFrame, pairs: list[tuple[str, str]],
                  refs: DataFrame | None) -> DataFrame:
    # Each question's answers become a map of at most |models| entries; the
    # literal pair list is exploded against it (no self-join of the answers).
    q = _questions(questions)
    m = pair_values(answers, pairs, "model_answer", "answer_1", "answer_2").join(q, "question_id")
    m = _with_refs(m, refs)
    m = m.withColumn("judge_prompt", judge_route(F.col("n_turns"), refs is not None, "pair"))
    return m.select("question_id", "category", "question", "n_turns", "model_1", "model_2",
                    "answer_1", "answer_2", "ref_answer", "judge_prompt")


def baseline_matches(questions: DataFrame, answers: DataFrame, models: list[str], baseline: str,
                     refs: DataFrame | None = None) -> DataFrame:
    """Each listed model against the baseline (a model never meets itself)."""
    if not baseline:
        raise ValueError("baseline mode needs a baseline model name")
    pairs = [(m, baseline) for m in models if m != baseline]
    return _pair_matches(questions, answers, pairs, refs)


def all_pair_matches(questions: DataFrame, answers: DataFrame, models: list[str],
                     refs: DataFrame | None = None) -> DataFrame:
    """Every model pair i < j in list order, per question."""
    pairs = [(a, b) for _, a, b in model_pairs(models)]
    return _pair_matches(questions, answers, pairs, refs)


def pair_values(values: DataFrame, pairs: list[tuple[str, str]], value: str, out_1: str, out_2: str,
                keys: list[str] | None = None) -> DataFrame:
    """One row per key (default: question) and model pair from ``pairs`` carrying both models' ``value``; pairs
    missing either value drop out.

    ``values`` must hold at most one row per key and model (after keep-last or an aggregate).  Each key holds a map of
    at most ``len(models)`` entries; the literal pair list becomes an array of structs with both values in the same projection
    as the map, so that what is exploded carries two values and not the map.
    """
    keys = keys or ["question_id"]
    models = sorted({m for p in pairs for m in p})
    per_key = (values.filter(F.col("model").isin(*models))
               .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("model", value))).alias("_m")))
    names = F.array(*[F.struct(F.lit(a).alias("model_1"), F.lit(b).alias("model_2")) for a, b in pairs])
    both = F.transform(names, lambda p: F.struct(p["model_1"].alias("model_1"), p["model_2"].alias("model_2"),
                                                 F.try_element_at("_m", p["model_1"]).alias(out_1), F.try_element_at("_m", p["model_2"]).alias(out_2)))
    met = F.filter(both, lambda p: p[out_1].isNotNull() & p[out_2].isNotNull())
    return per_key.select(*keys, F.explode(met).alias("_p")).select(*keys, "_p.*")


def shuffle_for_judging(matches: DataFrame, partitions: int, seed: int = 0,
                        keys: tuple[str, ...] = ("question_id", "model_1", "model_2")) -> DataFrame:
    """Spread matches over ``partitions`` tasks by a seeded hash of the match
    key, so concurrent judge calls mix questions and models (execution order
    only; results do not depend on it)."""
    present = [k for k in keys if k in matches.columns]
    return matches.repartition(partitions, F.xxhash64(*present, F.lit(seed)))


def filter_models(df: DataFrame, models: list[str] | None, cols: tuple[str, ...] = ("model",)) -> DataFrame:
    """Keep rows whose model column(s) are all in ``models`` (None keeps all)."""
    if not models:
        return df
    cond = None
    for c in cols:
        cond = F.col(c).isin(*models) if cond is None else cond & F.col(c).isin(*models)
    return df.filter(cond)


def match_stats(matches: DataFrame, questions: DataFrame, mode: str, judge: str,
                baseline: str | None, models: list[str]) -> DataFrame:
    """One-row match statistics."""
    # One aggregate over a tagged union: both counts in a single pass, no join.
    tagged = (questions.select(F.lit(1).alias("q"), F.lit(0).alias("m"))
              .unionByName(matches.select(F.lit(0).alias("q"), F.lit(1).alias("m"))))
    counts = tagged.agg(F.sum("q").cast("long").alias("total_num_questions"),
                        F.sum("m").cast("long").alias("total_num_matches"))
    return counts.select(
        F.lit(mode).alias("mode"), F.lit(judge).alias("judge"),
        F.lit(baseline).cast("string").alias("baseline"),
        F.lit(",".join(models)).alias("model_list"),
        "total_num_questions", "total_num_matches")
