import random
import re

import pytest

from gradebook.llm import quality_rules as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if SPACE.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(wins) if wins.count(w) > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed)


def rows(df):
    return {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b ", "cc ", "\n", "\t", " ", "a b cc ", "#", "|", "日", " ", "\x0b", "\r"]) for _ in range(rng.randint(0, 200)))
             for _ in range(60)] + [None, "", "\n\n", "x y z", "x y z x y z", "a a a a", "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = Q.quality_rules(df)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert all(not r.kept for r in out.where("base_failed").collect())


def test_each_rule_decides(spark):
    good = "This is the house that the people of the town have built with their own hands. " * 0 + " ".join(
        f"the house{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(40))
    bad = {"n_symbols": good.replace(" of", " #of"), "word_chars": good.replace("house", "h" * 70), "n_stop_words": good.replace("the ", "xy ").replace(" of", " zq"),
           "n_letter_words": re.sub(r"house\w+ of", lambda m: f"{hash(m[0]) % 10**6} {hash(m[0]) % 10**5}", good), "n_upper_words": good.upper()}
    df = spark.createDataFrame([("good", good), *bad.items()], "doc_id string, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.quality_rules(df).collect()}
    assert got.pop("good") == (False, True)
    assert set(got.values()) == {(False, False)}


def test_clean_documents_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, True), 0) >= 0.99 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.95 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_odd_empty_and_clashing(odd_docs, no_docs, clashing_docs):
    assert Q.quality_rules(odd_docs).count() == odd_docs.count()
    assert Q.quality_rules(no_docs).count() == 0
    assert rows(Q.quality_rules(clashing_docs)) == rows(Q.quality_rules(odd_docs))
