import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradebook.llm import suffix_dedup as S


def brute(rows, length):
    """Per row: id, merged spans, bytes left; every string of every document held against all smaller ones."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    order = lambda i: (i is None, i or 0)
    for i, t in raw:
        for s in range(len(t) - length + 1):
            w = t[s:s + length]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - length + 1):
            if first[t[s:s + length]] < order(i):
                gone[s:s + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])))
        out.append((i, [tuple(map(int, p)) for p in edge.reshape(-1, 2)], bytes(b for b, g in zip(t, gone, strict=False) if not g)))
    return sorted(out, key=str)


def kept(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted([(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in S.drop_passages(docs, **options).collect()], key=str)


def corpus(seed, n=60):
    """Passages shared by many documents, cut anywhere, beside words of their own; copies; umlauts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeü") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a:rng.randint(a, len(p))], " ".join(word() for _ in range(rng.randint(0, 9)))]
        rows.append((rng.randint(0, n), " ".join(parts)))
    return rows + rows[:4] + [(n + 5, rows[0][1]), (None, rows[1][1]), (None, rows[2][1] + "x")]


@pytest.mark.parametrize("options", [{}, {"length": 20, "gram": 8}, {"bucket_bytes": 500}, {"bucket_bytes": 2000, "bucket_limit": 300}])
def test_equals_brute_force(spark, monkeypatch, options):
    """Also with many buckets, with hot ones that are dealt again by window, and in many parts and steps."""
    if options:
        monkeypatch.setattr(S, "PART_BYTES", 1000)
        monkeypatch.setattr(S, "STEP", 100)
    rows = corpus(len(str(options)))
    assert kept(spark, rows, **options) == brute(rows, options.get("length", 50))


def test_slices_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 300)
    rows = [(1, "".join(chr(97 + i * i % 23) for i in range(2000))), (0, "".join(chr(97 + i * i % 23) for i in range(700, 1500))), (2, "word " * 700), (3, "word " * 900)]
    assert kept(spark, rows) == brute(rows, 50)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text("ab\x00", min_size=0, max_size=60)), max_size=8), st.sampled_from([9, 12]))
def test_the_passes_of_one_task(rows, length):
    """Cutting, packing and judging without Spark, on texts full of repeats."""
    import pyarrow as pa

    raw = [(i, t) for i, t in rows if len(t) >= length]
    cols = [pa.array([i for i, _ in raw], pa.int64()), pa.array(range(len(raw)), pa.int64()), pa.array([t for _, t in raw], pa.string())]
    sent = [r for b in S._cut(3, length, 8)([pa.RecordBatch.from_arrays(cols, ["doc", "row", "text"])]) for r in b.to_pylist()]
    for limit in (40, None):                                   # hot buckets first, then all that is left
        rows_ = sorted(sent, key=lambda r: (r["bucket"] is not None, r["bucket"] or 0))
        batch = S._batch([(r["bucket"], r["pack"]) for r in rows_ if r["bucket"] is not None],
                         [(r["doc"], r["row"], r["start"], r["end"]) for r in rows_ if r["bucket"] is None])
        sent = [r for b in S._judged(5, length, limit)([batch]) for r in b.to_pylist()]
    assert all(r["bucket"] is None for r in sent)
    spans = [(r["row"], r["start"], r["end"]) for r in sent]
    got = {row: {x for r, s, e in spans if r == row for x in range(s, e)} for row in range(len(raw))}
    for row, (i, t) in enumerate(raw):
        want = {x for s in range(len(t) - length + 1) for x in range(s, s + length) if any(j < i and t[s:s + length] in u for j, u in raw)}
        assert got[row] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=30))
def test_previous_smaller(pairs):
    pairs.sort(key=lambda p: p[0])
    seg, val = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    want = [max((j for j in range(i) if seg[j] == seg[i] and val[j] < val[i]), default=-1) for i in range(len(pairs))]
    assert S.previous_smaller(val, seg).tolist() == want


def test_odd_empty_and_clashing(spark, odd_docs, no_docs, clashing_docs):
    for docs in (odd_docs, clashing_docs):
        got = sorted([(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in S.drop_passages(docs).collect()], key=str)
        assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 50)
    assert S.drop_passages(no_docs).count() == 0
    assert S.drop_passages(no_docs).columns == ["doc_id", "spans", "kept"]


def test_one_passage_in_every_document_is_one_row_a_slice(spark):
    """A hot group is folded before the shuffle: what is sent does not grow with its copies."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same licence text in each and every document of the corpus " * 3).alias("text")).repartition(2)
    sent = S._texts(docs, "doc_id", "text").mapInArrow(S._cut(1, 50, 16), S._PACK).where("bucket is not null")
    assert sum(S._unpacked(r.pack)[0]["size"].sum() for r in sent.collect()) <= 2 * 1000
    out = S.drop_passages(docs)
    assert out.where("octet_length(kept) > 0").select("doc_id").collect() == [(0,)]
