"""Sources/sinks round trips, the batch model runner and streaming = batch."""

import json
import os
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradebook.operators import batchfn as U
from gradebook.sources import judgment_log as J
from gradebook.sources import readers as R
from gradebook.sources import writers as W


def test_raw_qa_csv_multiline_and_conversion(spark, tmpdir_):
    p = os.path.join(tmpdir_, "raw.csv")
    pd.DataFrame({
        "instruction": ["line1\nline2", None, "say \"hi\", ok", "nan"],
        "input": [None, "only input", "x", None],
        "output": ["o1", "o2", "o3", "o4"],
        "domain": ["d1", "d2", "d3", "d4"],
        "task": ["t1", "t2", "t3", "t4"],
    }).to_csv(p, index=False)
    from gradebook.operators.convert import convert_raw_qa
    raw = R.read_raw_qa_csv(spark, p, field_header="domain", task_header="task")
    out = convert_raw_qa(raw).orderBy("question_id").collect()
    assert [(r.question_id, r.question[0]) for r in out] == [(1, "line1\nline2"), (2, "only input"),
                                                            (3, 'say "hi", okx')]
    q, a = os.path.join(tmpdir_, "q"), os.path.join(tmpdir_, "a")
    W.write_questions_and_refs(convert_raw_qa(raw), q, a)
    assert R.read_questions(spark, q).count() == 3
    refs = R.read_answers(spark, a).collect()
    assert {r.model_answer[0] for r in refs} == {"o1", "o2", "o3"}


def test_answers_model_from_file_stem_and_keep_last(spark, tmpdir_):
    d = os.path.join(tmpdir_, "answers")
    os.makedirs(d)
    for model, lines in {"alpha": [(1, "a"), (2, "b"), (1, "c")], "beta": [(1, "x")]}.items():
        with open(os.path.join(d, f"{model}.jsonl"), "w") as f:
            for qid, ans in lines:
                f.write(json.dumps({"question_id": qid, "model_answer": [ans], "tstamp": 0.0}) + "\n")
    from gradebook.operators.keeplast import keep_last
    a = keep_last(R.read_answers(spark, d), ["model", "question_id"])
    got = sorted((r.model, r.question_id, r.model_answer[0]) for r in a.collect())
    assert got == [("alpha", 1, "c"), ("alpha", 2, "b"), ("beta", 1, "x")]


def test_judge_prompt_catalog_last_wins(spark, tmpdir_):
    p = os.path.join(tmpdir_, "prompts.jsonl")
    with open(p, "w") as f:
        for i, name in enumerate(["x", "y", "x"]):
            f.write(json.dumps({"name": name, "type": "single", "system_prompt": f"s{i}", "prompt_template": "{question}",
                                "description": "", "category": "", "output_format": "[[rating]]"}) + "\n")
    cat = R.read_judge_prompts(spark, p)
    assert cat["x"]["system_prompt"] == "s2" and set(cat) == {"x", "y"}


def test_mc_results_tree(spark, tmpdir_):
    root = os.path.join(tmpdir_, "result")
    for model, n, cot, subj in [("m1", 0, False, "net"), ("m1", 5, True, "net"), ("m2", 0, False, "os")]:
        d = os.path.join(root, model, f"ntrain={n}", f"cot={cot}")
        os.makedirs(d, exist_ok=True)
        pd.DataFrame({"id": [1, 2], "category": ["c", "d"], "correct": [1, 0]}).to_csv(
            os.path.join(d, f"{subj}_res.csv"), index=False)
    open(os.path.join(root, ".DS_Store"), "w").close()
    res = R.read_mc_results(spark, root, exclude_models=["m2"])
    keys = sorted({(r.model, r.ntrain, r.cot, r.subject) for r in res.collect()})
    assert keys == [("m1", 0, False, "net"), ("m1", 5, True, "net")]
    assert {r.n_files for r in R.leaf_file_counts(res).collect()} == {1}


def test_runs_that_break_the_leaf_rule(spark, tmpdir_):
    """Two files in a run, and a file whose columns are in another order: named in the error, or left out; never bound by position."""
    root = os.path.join(tmpdir_, "result")

    def put(model, subject, frame):
        d = os.path.join(root, model, "ntrain=5", "cot=False")
        os.makedirs(d, exist_ok=True)
        frame.to_csv(os.path.join(d, f"{subject}_res.csv"), index=False)

    good = pd.DataFrame({"id": [1, 2], "category": ["c\nd", "d"], "model_output": ["0", "1"], "correct": [1, 0]})
    put("m1", "net", good)
    put("m2", "net", good)
    put("m3", "net", good[["id", "category", "correct", "model_output"]])
    put("m4", "net", good)
    put("m4", "os", good)
    with pytest.raises(ValueError, match=r"m3/ntrain=5/cot=False: another header.*m4/ntrain=5/cot=False: 2 result files"):
        R.read_mc_results(spark, root)
    res = R.read_mc_results(spark, root, bad_runs="drop")
    assert sorted((r.model, r.id, r.correct) for r in res.collect()) == [("m1", "1", 1), ("m1", "2", 0), ("m2", "1", 1), ("m2", "2", 0)]
    assert R.read_mc_results(spark, root, exclude_models=["m3", "m4"]).count() == 4
    assert {r.model: r.problem for r in R.mc_run_checks(spark, root).collect()}["m1"] is None


def test_mc_csv_subjects(spark, tmpdir_):
    for subj, n in [("net", 3), ("db", 2)]:
        pd.DataFrame({"id": range(n), "question": ["q"] * n, "A": ["007"] * n, "B": ["b"] * n, "C": ["c"] * n,
                      "D": ["d"] * n, "answer": ["A"] * n, "category": ["x"] * n}).to_csv(
            os.path.join(tmpdir_, f"{subj}.csv"), index=False)
    mc = R.read_mc_csv(spark, os.path.join(tmpdir_, "*.csv"))
    assert {r.subject: r.n for r in R.subject_counts(mc).collect()} == {"net": 3, "db": 2}
    assert {r.A for r in mc.collect()} == {"007"}          # verbatim text, not re-formatted


def test_judgments_partitions_and_markdown(spark, tmpdir_):
    root = os.path.join(tmpdir_, "judgments")
    rows = spark.createDataFrame([(1, "a", "b", "model_1", "model_1", "g1", "g2")],
                                 "question_id long, model_1 string, model_2 string, g1_winner string, "
                                 "g2_winner string, g1_judgment string, g2_judgment string")
    J.append(rows, root, J.PAIR, bench="ops", judge_model="gpt-4", iid="r1")
    J.append(rows.withColumn("question_id", F.lit(2).cast("long")), root, J.PAIR, bench="ops", judge_model="gpt-4", iid="r2")
    got = J.read(spark, root, J.PAIR, bench="ops", iid="r2").collect()
    assert [r.question_id for r in got] == [2]
    md = os.path.join(tmpdir_, "board")
    from gradebook.operators.boards import win_board
    W.write_markdown(win_board(rows), md)
    text = "".join(open(os.path.join(md, f)).read() for f in sorted(os.listdir(md)) if f.startswith("part"))
    assert text.splitlines()[0].startswith("| model | win")


def test_model_runner_retry_sentinel_and_resume(spark, tmpdir_):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(6)], "k long, prompt string")

    def flaky_factory():
        def fn(batch):
            if (batch["prompt"] == "p3").any():
                raise RuntimeError("boom")
            return [p.upper() for p in batch["prompt"]]
        return fn

    out = U.call_model(df.repartition(6, "k"), flaky_factory, ["prompt"], max_retry=2, retry_sleep=0.0)
    got = {r.k: (r.output, r.error) for r in out.collect()}
    assert got[3][0] == "$ERROR$" and "boom" in got[3][1]
    assert got[1] == ("P1", None)

    path = os.path.join(tmpdir_, "store")
    calls = spark.sparkContext.accumulator(0)

    def counting_factory():
        def fn(batch):
            calls.add(len(batch))
            return list(batch["prompt"])
        return fn

    U.run_and_store(df.filter("k < 3"), counting_factory, ["prompt"], ["k"], path, retry_sleep=0.0)
    full = U.run_and_store(df, counting_factory, ["prompt"], ["k"], path, retry_sleep=0.0)
    assert full.count() == 6 and calls.value == 6            # finished keys are not re-run


def test_judgment_run_tag_is_a_partition_filter(spark, tmpdir_):
    root = os.path.join(tmpdir_, "j")
    rows = spark.createDataFrame([(1, "a", "b", "tie", "tie", "x", "y")],
                                 "question_id long, model_1 string, model_2 string, g1_winner string, "
                                 "g2_winner string, g1_judgment string, g2_judgment string")
    for iid in ("r1", "r2"):
        J.append(rows, root, J.PAIR, bench="ops", judge_model="gpt-4", iid=iid)
    plan = J.read(spark, root, J.PAIR, iid="r2")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(mode#\d+ = pair\)[^\]]*\(iid#\d+ = r2\)", plan)


def test_dialog_tokens_with_names(spark):
    from gradebook.functions.tokens import dialog_tokens
    df = spark.createDataFrame([([("user", "hi there", None), ("assistant", "ok", "bot")],)],
                               "d array<struct<role:string,content:string,name:string>>")
    plain = df.select(dialog_tokens("d", "gpt-4")).first()[0]
    named = df.select(dialog_tokens("d", "gpt-4", with_name=True)).first()[0]
    assert plain == (3 + 1 + 2) + (3 + 1 + 1) + 3 and named == plain + 1 + 1


def test_read_questions_slice_in_file_order(spark, tmpdir_):
    d = os.path.join(tmpdir_, "qs")
    os.makedirs(d)
    ids = [7, 3, 9, 1, 5, 8, 2]                      # file order differs from id order
    with open(os.path.join(d, "question.jsonl"), "w") as f:
        for i in ids:
            f.write(json.dumps({"question_id": i, "category": "c", "question": ["q"]}) + "\n")
    got = [r.question_id for r in R.read_questions(spark, d, 2, -1).orderBy("seq").collect()]
    assert got == ids[2:-1]


def test_unrated_records_are_rejected(spark):
    from gradebook.operators import instruct as I
    records = spark.createDataFrame([(1, "a", "b", "c"), (2, "d", "e", "f")], "id long, instruction string, input string, output string")
    parsed = I.parse_rating(spark.createDataFrame([(1, '{"score": 5, "reason": "r", "modified_data": "None"}')], "id long, rating_text string"))
    assert {r.id: r.decision for r in I.quality_gate(records, parsed, "id").collect()} == {1: "keep", 2: "reject"}


def test_tagged_prompt_opens_a_tag_only_for_an_empty_message(spark):
    from gradebook.operators import dialogs as D
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "")]
    got = {r.conv_id: r.prompt for r in D.render_tagged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1] == "<|User|>:hi<eou>\n<|Assistant|>:yes<eoa>\n"
    assert got[2] == "<|User|>:hi<eou>\n<|Assistant|>:"
