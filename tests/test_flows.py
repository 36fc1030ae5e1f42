"""End-to-end flows with offline models, including resume, on sf0.001 fixtures."""

import os

from pyspark.sql import functions as F

from gradebook import judge_prompts as JP
from gradebook.operators import batchfn as U
from gradebook.operators.keeplast import keep_last
from gradebook.plans import fixtures as fx
from gradebook.plans import flows
from gradebook.sources import judgment_log as J

SF = "/root/testdata/sf0.001"


def test_pairwise_flow_and_resume(spark, tmpdir_):
    def judge_factory():
        verdicts = ["[[A]]", "[[B]]", "[[C]]", "no verdict"]
        # Deterministic offline judge keyed on the rendered user prompt.
        return lambda batch: [verdicts[len(u) % 4] for u in batch.iloc[:, 1]]

    q = fx.questions(spark, SF)
    a = keep_last(fx.answer_log(spark, SF), ["question_id", "model"])
    out = os.path.join(tmpdir_, "pair")
    t1 = flows.judge_pairwise(q, a, ["m0", "m1", "m2"], JP.as_dict(), "gpt-4", judge_factory, out, partitions=4,
                              retry_sleep=0.0)
    n1 = t1.count()
    t2 = flows.judge_pairwise(q, a, ["m0", "m1", "m2"], JP.as_dict(), "gpt-4", judge_factory, out, partitions=4,
                              retry_sleep=0.0)
    assert n1 > 0 and t2.count() == n1                         # nothing judged twice
    assert set(r.g1_winner for r in t1.collect()) <= {"model_1", "model_2", "tie", "error"}


def test_single_flow(spark, tmpdir_):
    q = fx.questions(spark, SF)
    a = keep_last(fx.answer_log(spark, SF), ["question_id", "model"])

    def grader():
        return lambda batch: [f"Rating: [[{len(u) % 10}]]" for u in batch.iloc[:, 1]]

    t = flows.judge_single(q, a, ["m0", "m1"], JP.as_dict(), "gpt-4", grader, os.path.join(tmpdir_, "single"),
                           partitions=4, retry_sleep=0.0)
    assert t.filter(F.col("score") < 0).count() == 0 and t.count() > 0


def test_mc_flow_resume(spark, tmpdir_):
    val = fx.mc_questions(spark, SF)
    shots = fx.mc_shots(spark, SF)
    root = os.path.join(tmpdir_, "mc")
    acc = flows.evaluate_mc(val.filter("subject = 's0'"), shots, 5, flows.first_letter_model_factory("A"),
                            "mX", False, root, retry_sleep=0.0)
    assert {r.category for r in acc.collect()} >= {"ALL"}
    flows.evaluate_mc(val, shots, 5, flows.first_letter_model_factory("A"), "mX", False, root, retry_sleep=0.0)
    stored = spark.read.parquet(root)
    assert stored.count() == val.count()                       # s0 not re-run, the rest added
    exp = val.filter("answer = 'A'").count()
    assert stored.agg(F.sum("correct")).first()[0] == exp


def test_generate_answers_multi_turn(spark):
    q = spark.createDataFrame([(1, "math", ["q1", "q2"]), (2, "writing", ["only"])],
                              "question_id long, category string, question array<string>")

    def echo_factory():
        def gen(convs, temps):
            return [f"t={t} n={len(c)} last={c[-1][1]}</s>junk" for c, t in zip(convs, temps)]
        return gen

    out = {r.question_id: r.model_answer for r in
           U.generate_answers(q, echo_factory, "echo", stop="</s>", retry_sleep=0.0).collect()}
    assert out[1] == ["t=0.0 n=1 last=q1", "t=0.0 n=3 last=q2"]   # turn 2 sees turn 1's answer
    assert out[2] == ["t=0.7 n=1 last=only"]


def test_two_judges_share_a_table(spark, tmpdir_):
    q = fx.questions(spark, SF).limit(4)
    a = keep_last(fx.answer_log(spark, SF), ["question_id", "model"])
    out = os.path.join(tmpdir_, "two")
    judge = lambda: (lambda batch: ["Rating: [[5]]"] * len(batch))
    for name in ("gpt-4", "gpt-3.5-turbo", "gpt-4"):
        t = flows.judge_single(q, a, ["m0"], JP.as_dict(), name, judge, out, retry_sleep=0.0)
    assert {(r.judge_model, r["count"]) for r in t.groupBy("judge_model").count().collect()} == {("gpt-4", 4), ("gpt-3.5-turbo", 4)}
    assert J.read(spark, out, J.SINGLE).count() == 8                         # the third run asked nothing


def test_stored_errors_are_asked_again(spark, tmpdir_):
    q = fx.questions(spark, SF).limit(4)
    a = keep_last(fx.answer_log(spark, SF), ["question_id", "model"])
    out = os.path.join(tmpdir_, "down")

    def down():
        def judge(batch):
            raise RuntimeError("the judge is down")
        return judge

    args = dict(max_retry=2, retry_sleep=0.0)
    t = flows.judge_single(q, a, ["m0"], JP.as_dict(), "gpt-4", down, out, **args)
    assert {r.score for r in t.collect()} == {-1.0} and t.filter("error is null").count() == 0
    t = flows.judge_single(q, a, ["m0"], JP.as_dict(), "gpt-4", lambda: (lambda b: ["Rating: [[7]]"] * len(b)), out, **args)
    assert [(r.score, r.error) for r in t.collect()] == [(7.0, None)] * 4


def test_only_the_failing_row_of_a_batch_is_marked(spark):
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def model(batch):
            calls.add(len(batch))
            if "bad" in set(batch["x"]):
                raise ValueError("poison")
            return [f"ok {x}" for x in batch["x"]]
        return model

    df = spark.createDataFrame([(f"r{i}",) for i in range(15)] + [("bad",)], "x string").coalesce(1)
    got = {r.x: (r.output, r.error) for r in U.call_model(df, factory, ["x"], max_retry=3, retry_sleep=0.0).collect()}
    assert got.pop("bad") == ("$ERROR$", "ValueError: poison")
    assert all(v == (f"ok {k}", None) for k, v in got.items()) and len(got) == 15
    assert calls.value <= 3 * 16


def _log_flow(spark, root, bench, judge, models=("m0", "m1", "m2"), n=6, **more):
    q = fx.questions(spark, SF).orderBy("question_id").limit(n)
    a = keep_last(fx.answer_log(spark, SF), ["question_id", "model"])
    verdicts = ["[[A]]", "[[B]]", "[[C]]", "no verdict"]
    pair = lambda: (lambda b: [verdicts[len(u) % 4] for u in b.iloc[:, 1]])
    single = lambda: (lambda b: [f"Rating: [[{len(u) % 10}]]" for u in b.iloc[:, 1]])
    flows.judge_pairwise(q, a, list(models), JP.as_dict(), judge, pair, root, bench=bench, retry_sleep=0.0, **more)
    flows.judge_single(q, a, list(models), JP.as_dict(), judge, single, root, bench=bench, retry_sleep=0.0, **more)
    return q


def test_one_log_from_flow_to_reports(spark, tmpdir_):
    """Two judges and two benches write one root; boards and token totals read it; a repeated append changes nothing."""
    from gradebook import cli
    from gradebook.operators import boards as B
    root, qdir, out = (os.path.join(tmpdir_, x) for x in ("log", "q", "out"))
    for bench, judge in (("b1", "gpt-4"), ("b1", "gpt-3.5-turbo"), ("b2", "gpt-4")):
        q = _log_flow(spark, root, bench, judge)
    q.drop("seq").write.json(qdir)

    def show(mode, *more):
        return cli.main(["show", "--judgments", root, "--questions", qdir, "--mode", mode, "--out", out, *more], spark)

    rows = J.read(spark, root, J.PAIR)
    want = B.win_board(rows.where("bench = 'b1' and judge_model = 'gpt-4'")).collect()
    assert show("pairwise-all", "--bench", "b1", "--judge-model", "gpt-4")["pairwise_summary"].collect() == want and want
    assert show("single", "--bench", "b2")["single_summary"].agg(F.sum("n")).first()[0] == J.read(spark, root, J.SINGLE, bench="b2").count() > 0
    tok = {(r.bench, r.n) for r in cli.main(["tokens", "--judgments", root, "--kind", "pair", "--models", "m0", "m1", "--out", out], spark).collect()}
    n = rows.where("bench = 'b1' and model_1 in ('m0', 'm1') and model_2 in ('m0', 'm1')").count()
    assert tok == {("b1", 2 * n), ("b2", n)}
    # again, under a name: the second time nothing is written
    again = rows.drop("mode", "commit")
    for _ in range(2):
        J.append(again, root, J.PAIR, commit="again")
    assert J.read(spark, root, J.PAIR).count() == 2 * again.count()
    assert J.read(spark, root, J.PAIR, latest=True).count() == rows.where("commit != 'again'").count()


def test_a_run_that_died_is_not_read(spark, tmpdir_):
    root = os.path.join(tmpdir_, "log")
    row = spark.createDataFrame([(1, "m", "gpt-4", "single-v1", "[[3]]", 3.0)], "question_id long, model string, judge_model string, judge_prompt string, judgment string, score double")
    J.append(row, root, J.SINGLE, commit="one")
    # files of a commit that was never entered
    spark.read.parquet(root).withColumn("commit", F.lit("two")).write.mode("append").partitionBy(*J.PARTITIONS).parquet(root)
    assert spark.read.parquet(root).count() == 2 and [r.commit for r in J.read(spark, root, J.SINGLE).collect()] == ["one"]
    J.append(row, root, J.SINGLE, commit="two")                              # its next try replaces what was left
    assert spark.read.parquet(root).count() == 2 and J.read(spark, root, J.SINGLE).count() == 2


def test_pairs_from_single_gradings_resume(spark, tmpdir_):
    """Gradings come first; a pair exists per question, prompt and turn; failed gradings leave pairs out until they succeed."""
    root = os.path.join(tmpdir_, "log")
    q = spark.createDataFrame([(1, "math", ["a"]), (2, "writing", ["a", "b"])], "question_id long, category string, question array<string>")
    a = spark.createDataFrame([(i, m, [m * n, m]) for i in (1, 2) for m, n in (("x", 1), ("yy", 2), ("zzz", 3))], "question_id long, model string, model_answer array<string>")
    calls = spark.sparkContext.accumulator(0)

    def grader(broken):
        def factory():
            def grade(batch):
                calls.add(len(batch))
                if broken and any("zzzzzzzzz" in u for u in batch.iloc[:, 1]):
                    raise RuntimeError("no")
                return [f"[[{5 if 'yyyy' in u else 3}]]" for u in batch.iloc[:, 1]]
            return grade
        return factory

    def run(broken):
        t = flows.judge_pairs_by_single(q, a, ["x", "yy", "zzz"], JP.as_dict(), "gpt-4", grader(broken), root, bench="b", max_retry=1, retry_sleep=0.0)
        return {(r.question_id, r.model_1, r.model_2, r.turn): (r.m1_score, r.m2_score, r.g1_winner, r.g2_winner) for r in t.collect()}

    first = run(True)
    assert set(first) == {(1, "x", "yy", 1), (2, "x", "yy", 2)}
    assert first[1, "x", "yy", 1] == (3.0, 5.0, "model_2", "model_2")
    before = calls.value
    second = run(False)
    assert calls.value == before + 2 and len(second) == 6 and second[2, "x", "zzz", 2] == (3.0, 3.0, "tie", "tie")
    assert run(False) == second and calls.value == before + 2
    assert J.read(spark, root, J.PAIR).count() == 6


def test_stored_generation_goes_on_at_the_first_missing_turn(spark, tmpdir_):
    path = os.path.join(tmpdir_, "turns")
    q = spark.createDataFrame([(1, "math", ["a", "b", "c"]), (2, "writing", ["a"]), (3, "coding", ["x", "y"]), (4, "stem", [])],
                              "question_id long, category string, question array<string>")
    calls = spark.sparkContext.accumulator(0)

    def model(broken):
        def factory():
            def gen(convs, temps):
                calls.add(len(convs))
                if any(c[-1][1] == broken for c in convs):
                    raise RuntimeError("no")
                return [f"{len(c)}:{c[-1][1]}:{t}</s>junk" for c, t in zip(convs, temps, strict=True)]
            return gen
        return factory

    def run(broken=None):
        out = flows.generate_stored(q, model(broken), "m", path, stop="</s>", max_retry=1, retry_sleep=0.0)
        return {r.question_id: r.model_answer for r in out.collect()}

    assert run("b") == {2: ["1:a:0.7"], 3: ["1:x:0.0", "3:y:0.0"], 4: []}            # question 1 stops before its second turn
    before = calls.value
    want = {1: ["1:a:0.0", "3:b:0.0", "5:c:0.0"], 2: ["1:a:0.7"], 3: ["1:x:0.0", "3:y:0.0"], 4: []}
    assert run() == want and calls.value == before + 2                                 # the second and third turn of question 1 only
    assert run() == want and calls.value == before + 2
    assert spark.read.parquet(path).where("error is null").count() == 6
    # the answer log of the file layout, and back
    from gradebook.sources import readers as R
    from gradebook.sources import writers as W
    log = os.path.join(tmpdir_, "answers")
    done = flows.generate_stored(q, model(None), "m", path, stop="</s>", retry_sleep=0.0)
    W.append_answers(done, log)
    W.append_answers(done.where("question_id = 1"), log)
    back = keep_last(R.read_answers(spark, log), ["question_id", "model"])
    assert {(r.model, r.question_id): r.model_answer for r in back.collect()} == {("m", k): v for k, v in want.items()}


def test_complete_judging_needs_every_answer(spark, tmpdir_):
    import pytest
    q = spark.createDataFrame([(1, "stem", ["a"]), (2, "stem", ["b"])], "question_id long, category string, question array<string>")
    a = spark.createDataFrame([(1, "x", ["t"]), (2, "x", ["t"]), (1, "y", ["t"])], "question_id long, model string, model_answer array<string>")
    with pytest.raises(ValueError, match="missing model answers"):
        flows.judge_pairwise(q, a, ["x", "y"], JP.as_dict(), "gpt-4", lambda: None, os.path.join(tmpdir_, "log"), complete=True)


def _instruction_models(spark, calls, stop_after=None):
    import re

    def generator():
        def gen(batch):
            out = []
            for p in batch.iloc[:, 0]:
                calls.add(1)
                seeds = re.findall(r"(?m)^\d+\. (.*)$", p)
                out.append("\n".join(f"{i}. {x}" for i, x in enumerate([*(s + " more" for s in seeds), seeds[0], seeds[0].upper()], 1)))
            return out
        return gen

    def rater():
        def rate(batch):
            if stop_after is not None and calls.value is not None and len(batch):
                raise RuntimeError("the rater is down")
            score = lambda p: 5 if "more more" not in p else 2
            return ['{"score": %d, "reason": "r", "modified_data": %s}' % (score(p), '"None"' if score(p) == 5 else
                    '{"instruction": "rewritten %d", "input": "", "output": "o"}' % len(p)) for p in batch.iloc[:, 0]]
        return rate

    return generator, rater


def test_instruction_rounds_repeat_nothing_and_resume(spark, tmpdir_):
    import pytest
    root = os.path.join(tmpdir_, "grow")
    seeds = spark.createDataFrame([(f"seed {c}",) for c in "abcdefg"] + [("Seed A",)], "text string")
    calls = spark.sparkContext.accumulator(0)
    generator, down = _instruction_models(spark, calls, stop_after=0)
    _, rater = _instruction_models(spark, calls)
    options = dict(target=9, per_prompt=3, max_retry=1, retry_sleep=0.0)
    with pytest.raises(RuntimeError, match="calls failed"):
        flows.grow_instructions(seeds, generator, down, root, **options)
    asked = calls.value
    assert asked == 3                                                           # eight seeds in threes
    out = flows.grow_instructions(seeds, generator, rater, root, **options).collect()
    first = spark.read.parquet(os.path.join(root, "generated", "round=0"))
    assert first.where("error is null").count() == 3 and first.count() == 3     # the first round's lists were not asked for again
    texts = [r.instruction for r in out]
    assert len(out) == 9 and len({t.lower() for t in texts}) == 9 and not {t.lower() for t in texts} & {f"seed {c}" for c in "abcdefg"}
    assert {r.round for r in out} > {0} and {r.decision for r in out} <= {"keep", "rewrite"}
    n = calls.value
    assert flows.grow_instructions(seeds, generator, rater, root, **options).collect() == out and calls.value == n
