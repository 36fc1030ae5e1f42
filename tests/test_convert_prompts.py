"""Conversion, positions/slices, templates and prompt builders."""

import pytest
from pyspark.sql import functions as F

from gradebook.functions.templates import render
from gradebook.operators import convert as C
from gradebook.operators import prompts as P


def test_with_position_is_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("seq")).repartition(13)
    pos = C.with_position(df, "seq", "pos", partitions=6).orderBy("seq").collect()
    assert [r.pos for r in pos] == list(range(5000))


@pytest.mark.parametrize("begin,end", [(None, None), (3, None), (None, 5), (2, -3), (-4, None), (-4, -1),
                                       (10, 3), (50, None), (None, -50), (-50, 2)])
def test_python_slice(spark, begin, end):
    data = list(range(0, 40, 2))
    df = spark.createDataFrame([(x,) for x in data], "seq long")
    got = [r.seq for r in C.python_slice(df, "seq", begin, end).orderBy("seq").collect()]
    assert got == data[begin:end]


def test_merged_prompt_and_ids(spark):
    rows = [("a", None, "o1", "f", "t", 1), (None, None, "o2", "f", "t", 2), ("nan", "x", "o3", "f", "t", 3),
            (None, "y", "o4", "f", "t", 4), ("nan", "nan", "o5", "f", "t", 5)]
    raw = spark.createDataFrame(rows, "instruction string, input string, output string, ops_field string, "
                                      "task_type string, seq long")
    out = C.convert_raw_qa(raw).orderBy("question_id").collect()
    assert [(r.question_id, r.question[0], r.model_answer[0]) for r in out] == [(1, "a", "o1"), (2, "x", "o3"),
                                                                                (3, "y", "o4")]


def test_stop_cut_only_when_found(spark):
    df = spark.createDataFrame([("abc</s>junk",), ("  plain text  ",), ("</s>",)], "t string")
    assert [r[0] for r in df.select(C.stop_cut("t", "</s>")).collect()] == ["abc", "plain text", ""]


def test_temperature_map(spark):
    df = spark.createDataFrame([("math",), ("stem",), ("other",), (None,)], "c string")
    t = C.temperature("c")
    got = [(r[0], r[1]) for r in df.select(t, C.do_sample(t)).collect()]
    assert got == [(0.0, False), (0.1, True), (0.7, True), (0.7, True)]


def test_chunk_assign_remainder_and_error(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    got = [r.chunk for r in C.chunk_assign(df, "seq", 3).orderBy("seq").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        C.chunk_assign(df, "seq", 11)


def test_template_does_not_rescan_values(spark):
    df = spark.createDataFrame([("Q {answer_b}", "x {answer_a} 'q'\n{}", "B")], "q string, a string, b string")
    tmpl = "[Q]{question}[A]{answer_a}[B]{answer_b}"
    got = df.select(render(tmpl, {"question": "q", "answer_a": "a", "answer_b": "b"})).first()[0]
    assert got == tmpl.format(question="Q {answer_b}", answer_a="x {answer_a} 'q'\n{}", answer_b="B")


def test_short_turn_arrays_render_empty(spark):
    from gradebook import judge_prompts as JP
    cat = JP.as_dict()
    df = spark.createDataFrame([(["only one"], ["a1"], None, "single-v1-multi-turn")],
                               "question array<string>, answer array<string>, ref_answer array<string>, "
                               "judge_prompt string")
    out = P.single_judge_prompts(df, cat).first()
    assert "only one" in out.user_prompt and out.user_prompt.count("a1") == 1


def test_fewshot_clamps_per_subject(spark):
    shots = spark.createDataFrame(
        [(1, "q1", "a", "b", "c", "d", "A", "s1"), (2, "q2", "a", "b", "c", "d", "B", "s2"),
         (3, "q3", "a", "b", "c", "d", "C", "s2"), (4, "q4", "a", "b", "c", "d", "D", "s2")],
        "id long, question string, A string, B string, C string, D string, answer string, subject string")
    val = spark.createDataFrame([(9, "qq", "1", None, "3", "4", "A", "s1"), (10, "qr", "1", "2", "3", "4", "B", "s2")],
                                "id long, question string, A string, B string, C string, D string, answer string, "
                                "subject string")
    out = {r.id: r.input for r in P.few_shot(val, shots, 2).collect()}
    assert out[9].count(P.ANSWER_LABEL) == 2 and "B.\n" in out[9]        # one shot + the question
    assert out[10].count(P.ANSWER_LABEL) == 3 and "q4" not in out[10]    # two shots (clamped at n)


def test_fewshot_missing_subject_raises(spark):
    shots = spark.createDataFrame([(1, "q", "a", "b", "c", "d", "A", "s1")],
                                  "id long, question string, A string, B string, C string, D string, "
                                  "answer string, subject string")
    val = shots.withColumn("subject", F.lit("s9"))
    with pytest.raises(KeyError):
        P.few_shot(val, shots, 1)


def test_pluggable_arrow_tokenizer(spark):
    from gradebook.functions.tokens import arrow_tokenizer, message_tokens, regex_tokens
    df = spark.createDataFrame([("a b c",), ("hello, world!",), (None,)], "t string")
    ws = arrow_tokenizer(lambda s: s.split())
    got = [r[0] for r in df.select(ws(F.col("t"))).collect()]
    assert got == [3, 2, 0]
    assert [r[0] for r in df.select(regex_tokens("t")).collect()] == [3, 4, 0]
    # 3 per message + role + content, plus 3 for the reply priming
    n = df.select(message_tokens([("user", F.col("t"))], "gpt-4", ws)).first()[0]
    assert n == 3 + 1 + 3 + 3


def test_with_position_many_buckets_gaps_and_negatives(spark):
    import random
    rnd = random.Random(3)
    keys = rnd.sample(range(-10**12, 10**12), 20000)
    df = spark.createDataFrame([(k,) for k in keys], "seq long").repartition(17)
    got = C.with_position(df, "seq", "pos", partitions=50).collect()
    rank = {k: i for i, k in enumerate(sorted(keys))}
    assert all(r.pos == rank[r.seq] for r in got) and len(got) == len(keys)


def test_with_position_keeps_null_keys_first(spark):
    df = spark.createDataFrame([(5,), (None,), (1,), (3,)], "seq long")
    got = [(r.seq, r.pos) for r in C.with_position(df, "seq", "pos", partitions=3).orderBy("pos").collect()]
    assert got == [(None, 0), (1, 1), (3, 2), (5, 3)]
