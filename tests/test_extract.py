"""Verdict / letter extraction: literal edge cases and an independent Python model."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions import extract as X
from gradebook.operators.boards import percent2


def one(spark, expr, values, schema="t string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


# -- V1 ----------------------------------------------------------------------

def py_rating(text):
    m = re.search(fixed.ONE_SCORE_PATTERN, text) or re.search(fixed.ONE_SCORE_PATTERN_BACKUP, text)
    return float(m.group(1)) if m else -1.0


def test_rating_literals(spark):
    cases = {
        "Rating: [[8]]": 8.0, "[[8.5]]": 8.5, "[[8.]]": 8.0, "score [7]": 7.0, "[[05]]": 5.0,
        "[[11]]": 11.0, "[[a]]": -1.0, "": -1.0, "$ERROR$": -1.0, "[[3]] then [[9]]": 3.0,
        "[4] but [[6]]": 6.0,
    }
    got = one(spark, X.rating("t"), list(cases))
    assert got == list(cases.values())


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="[]0123456789.ab ,", max_size=14), min_size=1, max_size=20))
def test_rating_matches_python(spark, texts):
    assert one(spark, X.rating("t"), texts) == [py_rating(t) for t in texts]


# -- V2 / V3 ---------------------------------------------------------------

def test_letter_verdicts(spark):
    cases = {"[[A]] and [[B]]": "A", "[[B]]": "B", "[[C]]": "tie", "[A]": "error", "[[a]]": "error", "": "error"}
    assert one(spark, X.letter_verdict("t"), list(cases)) == list(cases.values())


def test_two_score_verdicts(spark):
    cases = {"[[8,7.9]]": "tie", "[[0.4,0.3]]": "A", "[8, 7]": "A", "[[2, 9]]": "B", "none": "error",
             "[[5,5.1]]": "tie"}
    assert one(spark, X.two_score_verdict("t"), list(cases)) == list(cases.values())


def test_game_winner_swap(spark):
    df = spark.createDataFrame([("A",), ("B",), ("tie",), ("error",)], "v string")
    g1 = [r[0] for r in df.select(X.game_winner(F.col("v"), swapped=False)).collect()]
    g2 = [r[0] for r in df.select(X.game_winner(F.col("v"), swapped=True)).collect()]
    assert g1 == ["model_1", "model_2", "tie", "error"]
    assert g2 == ["model_2", "model_1", "tie", "error"]


def test_unknown_format_raises(spark):
    df = spark.createDataFrame([("x", "[[zz]]")], "j string, f string")
    with pytest.raises(Exception):
        df.select(X.verdict_by_format("j", "f")).collect()


# -- E1-E3 -------------------------------------------------------------------

def py_letter(resp):
    r = resp.strip()
    if not r:
        return None
    if r[0] in fixed.MC_CHOICES:
        return r[0]
    for p in fixed.MC_ANSWER_PATTERNS:
        found = re.findall(p, r)
        if found:
            return found[-1]
    return None


MC_CASES = [
    "C", "　　B", "answer is The D", "答案是A，不对，答案是C", "the answer is （B）",
    "答案：（C）", "Because the answer is D", "All of them", "   ", "选B", "选项D", "正确的一项是 A",
    "the answer is: C", "the answer is (A)", "The answer is ： D", "xx answer is　B", "no idea",
    "答案应该是：B", "答案为 选项 C",
]


def test_mc_letter_literals(spark):
    assert one(spark, X.mc_letter("t"), MC_CASES) == [py_letter(c) for c in MC_CASES]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ABCDTabcdeinrsw :：()（）答案是为选项　\n", max_size=18), min_size=1, max_size=20))
def test_mc_letter_matches_python(spark, texts):
    assert one(spark, X.mc_letter("t"), texts) == [py_letter(t) for t in texts]


def test_mc_correct_case_insensitive_key(spark):
    df = spark.createDataFrame([("C", "c"), ("   ", "A"), ("B.", "b"), ("no", "A")], "r string, a string")
    assert [r[0] for r in df.select(X.mc_correct("r", "a")).collect()] == [1, 0, 1, 0]


def test_strict_first_letter_option(spark):
    vals = ["Because of X", "B. yes", "A"]
    assert one(spark, X.mc_letter("t", strict_first_letter=True), vals) == [None, "B", "A"]


# -- A12 rounding ------------------------------------------------------------

def test_percent_rounding_matches_numpy(spark):
    import numpy as np
    fracs = [(k, n) for n in range(1, 120) for k in range(0, n + 1)]
    df = spark.createDataFrame([(k / n,) for k, n in fracs], "x double")
    got = [r[0] for r in df.select(percent2(F.col("x"))).collect()]
    want = [float(np.round(k / n * 100, 2)) for k, n in fracs]
    assert got == want


@settings(max_examples=50, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é1_,.!\t\n\u0001ü中", max_size=20), min_size=1, max_size=20))
def test_regex_tokens_matches_python(spark, texts):
    import regex
    from gradebook.functions.tokens import regex_tokens
    ws = "[ \t\n\x0b\f\r]"   # Java's \s
    pat = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + ws[1:-1] + "]")
    assert one(spark, regex_tokens("t"), texts) == [len(pat.findall(t)) for t in texts]
