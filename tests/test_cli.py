"""The report command line over files written by the library's own writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gradebook import cli
from gradebook.sources import judgment_log as J


def _setup(spark, d):
    qdir = os.path.join(d, "q")
    os.makedirs(qdir)
    with open(os.path.join(qdir, "question.jsonl"), "w") as f:
        for i in range(6):
            f.write(json.dumps({"question_id": i, "category": "generic", "ops_field": f"f{i % 2}",
                                "task_type": "t", "question": [f"q{i}"]}) + "\n")
    pair = spark.createDataFrame(
        [(i, "a", "b", w1, w2, ["gpt-4", "pair-v2"], "u1", "[[A]]", "u2", "[[B]]", 1, 0.0)
         for i, (w1, w2) in enumerate([("model_1", "model_1"), ("model_2", "model_2"), ("tie", "tie"),
                                       ("model_1", "model_2"), ("model_1", "model_1"), ("error", "error")])],
        "question_id long, model_1 string, model_2 string, g1_winner string, g2_winner string, "
        "judge array<string>, g1_user_prompt string, g1_judgment string, g2_user_prompt string, "
        "g2_judgment string, turn int, tstamp double")
    J.append(pair, os.path.join(d, "log"), J.PAIR, bench="b", judge_model="gpt-4", iid="r1")
    single = spark.createDataFrame(
        [(i, m, ["gpt-4", "single-v1"], "prompt text", f"Rating: [[{s}]]", float(s), 1, 0.0)
         for i, (m, s) in enumerate([("a", 8), ("a", 6), ("b", 4), ("b", 2), ("a", 10), ("b", 3)])],
        "question_id long, model string, judge array<string>, user_prompt string, judgment string, "
        "score double, turn int, tstamp double")
    J.append(single, os.path.join(d, "log"), J.SINGLE, bench="b", judge_model="gpt-4", iid="r1")
    return qdir


def test_show_modes(spark, tmpdir_):
    qdir = _setup(spark, tmpdir_)
    out = os.path.join(tmpdir_, "out")
    b = cli.main(["show", "--judgments", os.path.join(tmpdir_, "log"), "--questions", qdir,
                  "--mode", "pairwise-all", "--label", "ops_field", "--iid", "r1", "--out", out], spark)
    summary = {r.model: (r.win, r.loss, r.tie) for r in b["pairwise_summary"].collect()}
    assert summary == {"a": (2, 1, 3), "b": (1, 2, 3)}
    assert os.path.isdir(os.path.join(out, "pairwise_label.md"))
    each = cli.main(["show", "--judgments", os.path.join(tmpdir_, "log"), "--questions", qdir,
                     "--mode", "pairwise-each", "--out", out], spark)
    assert {r.baseline for r in each["pairwise_each"].collect()} == {"a", "b"}
    s = cli.main(["show", "--judgments", os.path.join(tmpdir_, "log"), "--questions", qdir,
                  "--mode", "single", "--label", "ops_field", "--out", out], spark)
    assert {r.model: r.score for r in s["single_summary"].collect()} == {"a": 8.0, "b": 3.0}


def test_tokens_command(spark, tmpdir_):
    _setup(spark, tmpdir_)
    t = cli.main(["tokens", "--judgments", os.path.join(tmpdir_, "log"), "--kind", "pair",
                  "--out", os.path.join(tmpdir_, "tok")], spark)
    row = t.first()
    assert row.model_key == "a,b" and row.n == 12 and row.output_tokens > 0
    assert t.agg(F.sum("n")).first()[0] == 12


def test_convert_and_mc_score_commands(spark, tmpdir_):
    import pandas as pd
    raw = os.path.join(tmpdir_, "raw.csv")
    pd.DataFrame({"instruction": ["a", None], "input": [None, None], "output": ["x", "y"],
                  "dom": ["d", "d"], "task": ["t", "t"]}).to_csv(raw, index=False)
    cli.main(["convert", "--csv", raw, "--questions", os.path.join(tmpdir_, "q"), "--references",
              os.path.join(tmpdir_, "r"), "--field-header", "dom", "--task-header", "task"], spark)
    assert spark.read.json(os.path.join(tmpdir_, "q")).count() == 1
    root = os.path.join(tmpdir_, "result")
    for model, cats in [("m1", ["c", "c", "d"]), ("m2", ["c", "d", "d"])]:
        d = os.path.join(root, model, "ntrain=5", "cot=False")
        os.makedirs(d)
        pd.DataFrame({"id": [1, 2, 3], "category": cats, "correct": [1, 0, 1]}).to_csv(
            os.path.join(d, "net_res.csv"), index=False)
    acc = cli.main(["mc-score", "--results", root, "--out", os.path.join(tmpdir_, "mc")], spark)
    got = {(r.model, r.category): r.acc for r in acc.collect()}
    assert got[("m1", "c")] == 50.0 and got[("m1", "ALL")] == 75.0 and got[("m2", "ALL")] == 75.0


def test_nothing_to_report_is_an_error(spark, tmpdir_):
    qdir = _setup(spark, tmpdir_)
    args = ["show", "--questions", qdir, "--mode", "single", "--out", os.path.join(tmpdir_, "out"), "--judgments"]
    with pytest.raises(FileNotFoundError, match="no committed judgments"):
        cli.main([*args, os.path.join(tmpdir_, "nowhere")], spark)
    with pytest.raises(SystemExit, match="no single judgments"):
        cli.main([*args, os.path.join(tmpdir_, "log"), "--iid", "other"], spark)


def test_imported_lines_and_own_prompts(spark, tmpdir_):
    """A JSON-lines log of two benches goes into the log once, and its tokens are counted with the user's own catalog."""
    prompts = os.path.join(tmpdir_, "prompts.jsonl")
    with open(prompts, "w") as f:
        f.write(json.dumps({"name": "mine", "type": "single", "system_prompt": "two words", "prompt_template": "{question}",
                            "description": "", "category": "", "output_format": "[[rating]]"}) + "\n")
    log = os.path.join(tmpdir_, "log")
    for bench in ("b1", "b2", "b1"):
        path = os.path.join(tmpdir_, f"{bench}.jsonl")
        with open(path, "w") as f:
            for i in range(3):
                f.write(json.dumps({"question_id": i, "model": "m", "judge": ["gpt-4", "mine"], "user_prompt": "a b c", "judgment": "[[5]]",
                                    "score": 5, "turn": 1, "tstamp": 1.5}) + "\n")
        cli.main(["import", "--file", path, "--judgments", log, "--mode", "single", "--bench", bench, "--commit", bench], spark)
    t = cli.main(["tokens", "--judgments", log, "--prompts", prompts, "--out", os.path.join(tmpdir_, "tok")], spark).collect()
    assert {(r.bench, r.mode, r.model_key, r.n) for r in t} == {("b1", "single", "m", 3), ("b2", "single", "m", 3)}
    assert len({r.input_tokens for r in t}) == 1
    with pytest.raises(Exception, match="no judge prompt of this name"):
        cli.main(["tokens", "--judgments", log, "--out", os.path.join(tmpdir_, "tok2")], spark)
