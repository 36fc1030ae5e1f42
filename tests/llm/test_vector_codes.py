import hashlib

import numpy as np
import pytest

from gradebook.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    """(id, code, error, label_error, sha) by comparing every part with every entry, in Python integers."""
    rows = [(i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(rows[0][2]) // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    books = [[cut(r[2], p) for r in rows[:entries]] for p in range(parts)]

    def nearest(v, p):
        return min((sum((x - y) ** 2 for x, y in zip(cut(v, p), c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        new = [[list(c) for c in b] for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(r[2], p) for r in rows if nearest(r[2], p)[1] == e]
                if mine:
                    new[p][e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = [(i, lab, "".join(f"{nearest(v, p)[1]:02x}" for p in range(parts)), sum(nearest(v, p)[0] for p in range(parts))) for i, lab, v in rows]
    of = {lab: sum(e for _, x, _, e in out if x == lab) for lab in {o[1] for o in out}}
    return sorted([(i, c, e, of[lab], sha) for i, lab, c, e in out], key=str)


def coded(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    return sorted(map(tuple, V.vector_codes(table, **options).collect()), key=str)


@pytest.mark.parametrize("parts,entries,rounds", [(2, 7, 2), (4, 3, 1), (1, 40, 3), (8, 5, 0)])
def test_equals_brute_force(spark, monkeypatch, parts, entries, rounds):
    """Several blocks a position, a third of equal vectors, ties, negative sums, repeated and null ids, a null label."""
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(parts)
    hot = [0.25, -0.5] * 4
    rows = [(None if i == 77 else i // 2 if i > 150 else i, None if i % 11 == 0 else i % 4, hot if i % 3 == 0 else np.round(rng.normal(size=8), 1).tolist()) for i in range(200)]
    rows += rows[:5]
    assert coded(spark, rows, parts=parts, entries=entries, rounds=rounds) == brute(rows, parts, entries, rounds)


def test_shortlists_hold_the_nearest_and_are_short():
    rng = np.random.default_rng(1)
    book = rng.integers(-50, 50, (64, 4))
    x = rng.integers(-50, 50, 4) + rng.integers(-3, 4, (20, 256, 4))
    mask = V.shortlists(x.min(axis=1), x.max(axis=1), book)
    near = ((x[:, :, None] - book) ** 2).sum(axis=3)
    least = near.min(axis=2, keepdims=True)
    assert not ((near == least).any(axis=1) & ~mask).any()          # ties included
    assert mask.sum(axis=1).mean() < 32


def test_rows_that_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 2.0]), (3, None, [-1.0, 0.001])]
    rows = [*good, (1, 1, None), (2, 1, [nan, 1.0]), (4, 1, [inf, 0.0]), (5, 1, [None, 1.0]), (6, 1, [1.0]), (7, 1, [])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<double>, code int, row int, part int")
    assert sorted(map(tuple, V.vector_codes(table, parts=2).collect())) == brute(good, 2, 64, 2)
    for none in (table.limit(0), table.where("vec_id = 1")):
        assert V.vector_codes(none).count() == 0 and V.vector_codes(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        V.vector_codes(table, parts=3)
    with pytest.raises(Exception, match="component too large"):
        V.vector_codes(spark.createDataFrame([(0, 1, [1e12, 0.0])], "vec_id long, label int, embedding array<double>"), parts=2).collect()
