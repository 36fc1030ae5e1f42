"""End-to-end evaluation jobs composed from the operators.

QA judging:  questions + answers -> matches (J) -> prompts (P) -> judge calls (U1,
             spread by O6) -> verdicts (V) -> judgment table (N3/N4, resumable)
Answers:     questions -> turn by turn -> model (U2) -> table of turns (resumable)
Instructions: seeds -> prompts (I1) -> model -> items (I2) -> novelty (I3) -> ratings (I4, I5)
             -> gate (I6), in rounds up to a target (resumable)
MC scoring:  items + shots -> prompts (F) -> pending subjects (X1) -> model (U4)
             -> letters (E) -> result table (N8) -> accuracy board (A10-A12)

Model calls are written to storage before anything aggregates them, and keys
already stored are skipped on the next run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.functions.extract import letter_correct, mc_letter
from gradebook.functions.text import normalize_text
from gradebook.operators import batchfn as U
from gradebook.operators import boards as B
from gradebook.operators import convert as C
from gradebook.operators import instruct as I
from gradebook.operators import matches as M
from gradebook.operators import prompts as P
from gradebook.operators import verdicts as V
from gradebook.session import read_parquet_if_exists
from gradebook.sources import judgment_log as J
from gradebook.sources.writers import write_mc_results

#: Judgments of questions with several turns belong to the second.
_TURN = "IF(n_turns > 1, 2, 1)"


def judge_pairwise(questions: DataFrame, answers: DataFrame, models: list[str], catalog: dict[str, dict],
                   judge_model: str, judge_factory: Callable, log: str, baseline: str | None = None,
                   refs: DataFrame | None = None, partitions: int | None = None, bench: str = J.NONE, iid: str = J.NONE,
                   commit: str | None = None, complete: bool = False, **retry) -> DataFrame:
    """Pairwise judging (all pairs, or each model against ``baseline``), both position orders, into the judgment log
    ``log``.  Finished judgments of this bench, judge and run tag are not asked again; ``commit`` names the append; with
    ``complete`` a missing answer is an error (J1)."""
    if complete:
        M.assert_complete(questions, answers, [*models, *([baseline] if baseline else [])])
    if baseline is None:
        m = M.all_pair_matches(questions, answers, models, refs)
    else:
        m = M.baseline_matches(questions, answers, models, baseline, refs)
    keys = J.KEYS[J.PAIR]
    spark = questions.sparkSession
    done = J.stored(spark, log, J.PAIR, bench=bench, judge_model=judge_model, iid=iid)
    p = P.pair_judge_prompts(m, catalog, judge_model, M.route_names(refs is not None, "pair"))
    p = p.withColumns({"bench": F.lit(bench), "iid": F.lit(iid), "judge_model": F.lit(judge_model), "turn": F.expr(_TURN)})
    # Finished keys go first; only the remaining prompts are spread over the tasks.
    todo = p if done is None else U.pending(p, done, keys)
    todo = M.shuffle_for_judging(todo, partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))).select(
        *keys, "system_prompt", "g1_user_prompt", "g2_user_prompt")

    def both_games(df: DataFrame) -> DataFrame:
        # Both position orders in one Arrow pass over the matches.
        g = U.call_model_multi(df, judge_factory, [(["system_prompt", "g1_user_prompt"], "g1_judgment"),
                                                   (["system_prompt", "g2_user_prompt"], "g2_judgment")], **retry)
        return (g.withColumnRenamed("g1_judgment_error", "g1_error")
                .withColumnRenamed("g2_judgment_error", "g2_error"))

    judged = V.with_game_winners(both_games(todo))
    J.append(judged.withColumn("tstamp", F.unix_timestamp().cast("double")), log, J.PAIR, commit)
    return J.read(spark, log, J.PAIR, latest=True)


def judge_single(questions: DataFrame, answers: DataFrame, models: list[str], catalog: dict[str, dict],
                 judge_model: str, judge_factory: Callable, log: str, refs: DataFrame | None = None,
                 partitions: int | None = None, bench: str = J.NONE, iid: str = J.NONE, commit: str | None = None,
                 complete: bool = False, **retry) -> DataFrame:
    """Single-answer grading into the judgment log ``log``, resumable, with scores; with ``complete`` a missing answer is an error."""
    if complete:
        M.assert_complete(questions, answers, models)
    m = M.single_matches(questions, answers, models, refs)
    keys = J.KEYS[J.SINGLE]
    spark = questions.sparkSession
    done = J.stored(spark, log, J.SINGLE, bench=bench, judge_model=judge_model, iid=iid)
    p = P.single_judge_prompts(m, catalog, M.route_names(refs is not None, "single"))
    p = p.withColumns({"bench": F.lit(bench), "iid": F.lit(iid), "judge_model": F.lit(judge_model), "turn": F.expr(_TURN)})
    todo = p if done is None else U.pending(p, done, keys)
    todo = M.shuffle_for_judging(todo, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), keys=("question_id", "model")).select(
        *keys, "system_prompt", "user_prompt")
    j = U.call_model(todo, judge_factory, ["system_prompt", "user_prompt"], "judgment", **retry)
    J.append(V.with_rating(j).withColumn("tstamp", F.unix_timestamp().cast("double")), log, J.SINGLE, commit)
    return J.read(spark, log, J.SINGLE, latest=True)


def judge_pairs_by_single(questions: DataFrame, answers: DataFrame, models: list[str], catalog: dict[str, dict],
                          judge_model: str, judge_factory: Callable, log: str, baseline: str | None = None,
                          refs: DataFrame | None = None, bench: str = J.NONE, iid: str = J.NONE, commit: str | None = None, **options) -> DataFrame:
    """V5: pair outcomes from two single gradings, both in one log.

    The missing gradings of all models are made and stored first; then, for each question, turn and prompt, every
    pair (all pairs, or each model against ``baseline``) that is not in the log yet gets its two scores and one winner for
    both games.  A failed grading leaves its pairs out; a later run grades it again and adds them.
    """
    spark, where = questions.sparkSession, {"bench": bench, "judge_model": judge_model, "iid": iid}
    graded = models if baseline is None else list(dict.fromkeys([*models, baseline]))
    judge_single(questions, answers, graded, catalog, judge_model, judge_factory, log, refs, bench=bench, iid=iid, **options)
    scores = U.without_errors(J.read(spark, log, J.SINGLE, latest=True, **where))
    pairs = [(a, b) for _, a, b in M.model_pairs(models)] if baseline is None else [(m, baseline) for m in models if m != baseline]
    found = V.pairs_from_single(scores, pairs).withColumns({k: F.lit(v) for k, v in where.items()})
    done = J.stored(spark, log, J.PAIR, **where)
    todo = found if done is None else U.pending(found, done, J.KEYS[J.PAIR])
    J.append(todo.withColumn("tstamp", F.unix_timestamp().cast("double")), log, J.PAIR, commit)
    return J.read(spark, log, J.PAIR, latest=True, **where)


def evaluate_mc(val: DataFrame, shots: DataFrame, ntrain: int, model_factory: Callable, model_name: str,
                cot: bool, out_root: str, **retry) -> DataFrame:
    """Multiple-choice run: prompts, skip subjects already stored, call the model,
    extract letters, store results partitioned by run and subject, and return the
    accuracy board of everything stored."""
    cot = bool(cot) and ntrain > 0
    prompts = P.zero_shot(val) if ntrain == 0 else P.few_shot(val, shots, ntrain)
    prompts = prompts.select("*", F.lit(model_name).alias("model"), F.lit(ntrain).alias("ntrain"),
                             F.lit(cot).alias("cot"))
    spark = val.sparkSession
    run_keys = ["model", "ntrain", "cot", "subject"]
    done = read_parquet_if_exists(spark, out_root)
    if done is not None:      # a run with an error in it is not finished: its failed items are asked again
        failed = done.join(U.without_errors(done), [*run_keys, "id"], "left_anti").select(*run_keys, "id").distinct()
        todo = U.pending(prompts, done.select(*run_keys), run_keys).unionByName(prompts.join(failed, [*run_keys, "id"], "left_semi"))
    else:
        todo = prompts
    out = U.call_model(todo, model_factory, ["input"], "model_output", **retry)
    out = out.withColumn("letter", mc_letter("model_output")).withColumn("correct", letter_correct("letter", "answer"))
    write_mc_results(out.drop("input", "output", "choices"), out_root)
    return B.mc_accuracy(U.finished(spark.read.parquet(out_root), [*run_keys, "id"]))


def generate_stored(questions: DataFrame, factory: Callable, model_id: str, path: str, stop: str | None = None, **retry) -> DataFrame:
    """U2 as a stored job: the answers of ``model_id`` to every turn, one table row a turn under ``path``.

    Turn by turn over all questions: a turn is asked once the ones before it are answered, with the stored answers as its
    conversation, and written before the next turn starts.  A run that was stopped, or whose calls failed, goes on at the first
    missing turn of each question.  Returns the questions whose turns are all answered.
    """
    spark = questions.sparkSession
    q = questions.select("question_id", "category", "question", C.temperature("category").alias("temperature"))
    last = q.agg(F.max(F.size("question"))).first()[0] or 0
    keys = ["model_id", "question_id", "turn"]

    def answered() -> DataFrame | None:
        rows = read_parquet_if_exists(spark, path)
        return None if rows is None else U.without_errors(U.finished(rows, keys)).where(F.col("model_id") == model_id)

    for turn in range(last):
        todo = q.where(F.size("question") > turn).withColumns({"model_id": F.lit(model_id), "turn": F.lit(turn)})
        done = answered()
        if done is not None:
            todo = U.pending(todo, done, keys)
        if turn:
            before = done.where(F.col("turn") < turn).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("said"))
            todo = todo.join(before.where(F.size("said") == turn), "question_id")
        else:
            todo = todo.withColumn("said", F.expr("cast(array() as array<struct<turn: int, text: string>>)"))
        message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
        past = F.flatten(F.transform("said", lambda x: F.array(message("user", F.get("question", x["turn"])), message("assistant", x["text"]))))
        asked = F.concat(past, F.array(message("user", F.get("question", turn))))
        work = todo.select(*keys, asked.alias("conversation"), "temperature")
        out = U.generate_turns(work, factory, stop, **retry).select(*keys, "text", "error", F.unix_timestamp().cast("double").alias("tstamp"))
        out.write.mode("append").parquet(path)
    done = answered()
    empty = "cast(array() as array<string>)"
    if done is None:
        return q.where("false").select("question_id", "category", "question", F.lit(model_id).alias("model_id"), F.expr(empty).alias("model_answer"), F.lit(0.0).alias("tstamp"))
    texts = done.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("said"), F.max("tstamp").alias("tstamp"))
    full = q.join(texts, "question_id", "left").where(F.coalesce(F.size("said"), F.lit(0)) >= F.size("question"))
    return full.select("question_id", "category", "question", F.lit(model_id).alias("model_id"),
                       F.coalesce(F.transform("said", lambda x: x["text"]), F.expr(empty)).alias("model_answer"), F.coalesce("tstamp", F.lit(0.0)).alias("tstamp"))


def grow_instructions(seeds: DataFrame, generator: Callable, rater: Callable, root: str, target: int, per_prompt: int = 5,
                      max_rounds: int = 10, **retry) -> DataFrame:
    """I1-I6 as one loop: from ``seeds`` (text) to ``target`` accepted instruction records, in rounds.

    A round makes expansion prompts from the seeds and all records accepted so far, in an order of its own; calls the generator; cuts its
    lists into items; drops items that equal a seed or anything generated or accepted in earlier rounds; has the rest rated; and
    keeps, rewrites or rejects them.  Rewritten texts are checked for novelty once more.  Every call is stored under ``root`` before it
    is used, and a finished round is entered as a folder of ``accepted``; so a run that was stopped, or raised an error because calls
    failed, repeats no successful call.  It ends at the target, or after a round that accepts nothing.
    """
    spark = seeds.sparkSession
    first = seeds.select(F.col("text").alias("instruction")).where(F.length("text") > 0)
    part = lambda name, k: f"{root.rstrip('/')}/{name}/round={k}"

    def kept(name: str, k: int, rows: Callable[[], DataFrame]) -> DataFrame:
        """A table of round ``k``, made once."""
        old = read_parquet_if_exists(spark, part(name, k))
        if old is None:
            rows().write.mode("errorifexists").parquet(part(name, k))
            old = spark.read.parquet(part(name, k))
        return old

    def all_done(calls: DataFrame) -> DataFrame:
        failed = calls.where("error is not null").count()
        if failed:
            raise RuntimeError(f"{failed} calls failed; the next run makes them again and goes on")
        return calls

    accepted: list[DataFrame] = []
    tried: list[DataFrame] = []
    have = 0
    for k in range(max_rounds):
        if have >= target:
            break
        pool = reduce(DataFrame.union, [a.select("instruction") for a in accepted], first)
        old = reduce(DataFrame.union, [t.select("instruction") for t in tried], pool)

        def prompts(pool=pool, k=k) -> DataFrame:
            # No two texts alike, so their hash with the round and the text order them.
            texts = pool.distinct().withColumn("place", F.struct(F.xxhash64("instruction", F.lit(k)).alias("h"), "instruction"))
            return I.seed_prompts(texts, "place", "instruction", per_prompt)

        asked = kept("prompts", k, prompts)
        said = all_done(U.run_and_store(asked, generator, ["prompt"], ["group_id"], part("generated", k), **retry))

        def candidates(said=said, old=old, k=k) -> DataFrame:
            items = I.parse_numbered(said, "group_id", "output")
            new = I.new_and_distinct(items, old, "group_id", "instruction")
            return items.join(new.select("group_id", "item_pos"), ["group_id", "item_pos"]).select(
                F.concat_ws("-", F.lit(k), "group_id", "item_pos").alias("id"), F.col("item").alias("instruction"), F.lit("").alias("input"), F.lit("").alias("output"))

        new = kept("candidates", k, candidates)
        tried.append(new)
        rated = all_done(U.run_and_store(I.rating_prompt(new), rater, ["rating_prompt"], ["id"], part("rated", k), output="rating_text", **retry))

        def good(new=new, rated=rated, old=old) -> DataFrame:
            gate = I.quality_gate(new, I.parse_rating(rated.select("id", "rating_text")), "id").where("decision in ('keep', 'rewrite')")
            gate = gate.withColumn("norm", normalize_text("instruction"))
            others = old.select(normalize_text("instruction").alias("norm"))
            once = gate.groupBy("norm").agg(F.min("id").alias("id"))
            return gate.join(once, ["norm", "id"], "left_semi").join(others, "norm", "left_anti").drop("norm")

        done = kept("accepted", k, good).withColumn("round", F.lit(k))
        n = done.count()
        accepted.append(done)
        have += n
        if not n:
            break
    columns = ["round", "id", "decision", "score", "instruction", "input", "output"]
    if not accepted:
        return spark.createDataFrame([], "round int, id string, decision string, score int, instruction string, input string, output string")
    return reduce(DataFrame.union, [a.select(*columns) for a in accepted]).orderBy("round", "id").limit(target)


def first_letter_model_factory(letter: str = "A") -> Callable:
    """Offline MC model answering ``letter`` to everything (tests and examples)."""
    def factory():
        return lambda batch: [f"The answer is {letter}." for _ in range(len(batch))]
    return factory
