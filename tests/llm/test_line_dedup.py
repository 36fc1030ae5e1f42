import random

import pytest

from gradebook.llm import line_dedup

WORDS = ["ab", "cd", "ef", "gh"]


def distance(a, b):
    """Word edit distance by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, least):
    """Every line with words against every earlier one: equal, or both of ``least`` words and one word apart."""
    lines = []
    for id_, text in {(d[0], d[1]) for d in docs}:
        for no, line in enumerate((text or "").split("\n")):
            words = line.encode().lower().split()
            if words:
                lines.append(((id_ is not None, id_ or 0), no, text, words))
    gone = set()
    for p in lines:
        if any(q[:2] < p[:2] and (q[3] == p[3] or min(len(q[3]), len(p[3])) >= least and abs(len(q[3]) - len(p[3])) <= 1 and distance(q[3], p[3]) <= 1) for q in lines):
            gone.add((p[0], p[2], p[1]))
    return sorted(str((id_, None if text is None else "\n".join(x for no, x in enumerate(text.split("\n"))
                                                              if ((id_ is not None, id_ or 0), text, no) not in gone))) for id_, text in docs)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9)))
    bases = [line() for _ in range(6)]

    def near():
        w = rng.choice(bases).split()
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(w))
            w[i:i + rng.randint(0, 1)] = [rng.choice(WORDS)] * rng.randint(0, 2)
        return rng.choice([" ", "  ", "\t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)

    docs = [(i, "\n".join(near() if rng.random() < 0.7 else line() for _ in range(rng.randint(0, 6)))) for i in range(25)]
    docs += [(30, None), (None, "\n".join(bases)), docs[3], docs[4]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = line_dedup.dedupe_lines(df, min_words=3).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == brute(docs, 3)
    assert {(r.doc_id, r._line_count) for r in got} == {(i, 0 if t is None else t.count("\n") + 1) for i, t in docs}


def test_variants_name_the_word_left_out():
    words = b"a b c d e f".split()
    z = line_dedup.variants(words)
    for i in range(len(words)):
        assert z[i + 1] == line_dedup.variants(words[:i] + words[i + 1:])[0]
    assert len(set(z.tolist())) == len(z)


@pytest.mark.parametrize("a,b,yes", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "b c", True), ("a b c", "a b c d", True),
                                     ("a b c", "x b y", False), ("a b c", "b a c", False), ("", "a", True), ("a b", "a b c d", False)])
def test_within_one(a, b, yes):
    assert line_dedup.within_one(a.split(), b.split()) == yes == (distance(a.split(), b.split()) <= 1)


def test_odd_empty_and_clashing(odd_docs, no_docs, clashing_docs):
    got = line_dedup.dedupe_lines(odd_docs).collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], 8)
    assert line_dedup.dedupe_lines(no_docs).count() == 0
    from pyspark.sql import functions as F
    own = {c: F.lit(f"own {c}") for c in ("_line_count", "_removed_lines", "__lines", "__removed", "_all_", "_gone_", "_doc_", "_n_", "_tkey_", "_rid_")}
    out = line_dedup.dedupe_lines(clashing_docs.withColumns(own))
    assert set(clashing_docs.columns) <= set(out.columns) and out.count() == clashing_docs.count()
    first = out.first()
    assert all(first[c] == f"own {c}" for c in own if c not in ("_line_count", "_removed_lines")) and first._line_count >= 0


def test_no_equal_line_stays_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = [tuple(x.lower().split()) for r in line_dedup.dedupe_lines(docs).collect() for x in (r.text or "").encode().split(b"\n")]
    assert len([x for x in left if x]) == len({x for x in left if x}) > 0
