import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradebook.llm import hard_negatives as H
from gradebook.llm.common import COMPONENT


def brute(rows, every=50, positives=5, negatives=3):
    """All rows against all anchors, in Python integers."""
    rows = [(i, t, tuple(int(np.floor(256.0 * x)) for x in v)) for i, t, v in set(rows)]
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))
        order = sorted(((-score(w), i, t) for i, t, w in rows if i != a))
        for s, p, _ in [o for o in order if o[2] == label][:positives]:
            found = [o for o in order if o[2] != label and 50 * -s <= 100 * -o[0] <= 95 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    return sorted(map(tuple, H.hard_negatives(table, **options).collect()))


def test_equals_brute_force_on_clusters(spark, monkeypatch):
    """Many anchors near each other, a hot label, copies and ties, several trees and blocks."""
    monkeypatch.setattr(H, "TREE", 8)
    monkeypatch.setattr(H, "BLOCK", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4))
    rows = [(i, int(rng.integers(4)) if i % 3 else 1, tuple(float(x) for x in np.round(centres[i % 6] + rng.normal(size=4) * 0.2, 1).astype(np.float32))) for i in range(300)]
    rows += rows[:20] + [(5, 2, rows[7][2]), (10, 3, rows[10][2])]
    assert mined(spark, rows, every=5) == brute(rows, every=5)


def test_windows_at_zero_and_below(spark):
    rows = [(0, 1, (1.0, 0.0)), (1, 1, (0.0, 1.0)), (2, 1, (-1.0, 0.0)), (3, 2, (0.0, 2.0)), (4, 2, (0.5, 0.0)), (5, 2, (-0.7, 0.0)), (50, 2, (2.0, 2.0))]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 0.9]), (2, 2, [0.6, 0.6]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]),
            (7, 2, [0.7, None]), (8, 2, [0.7]), (9, 2, []), (None, 2, [0.7, 0.7])]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, label int, embedding array<double>, aid int, chunk int, rank int")
    assert sorted(map(tuple, H.hard_negatives(table).collect())) == brute([(0, 1, (1.0, 1.0)), (1, 1, (1.0, 0.9)), (2, 2, (0.6, 0.6))])
    for none in (table.limit(0), table.where("vec_id = 4"), table.where("vec_id > 0"), table.where("vec_id = 0")):
        assert H.hard_negatives(none).count() == 0
    with pytest.raises(Exception, match="component too large"):
        H.hard_negatives(spark.createDataFrame([(0, 1, [float(COMPONENT)])], "vec_id long, label int, embedding array<double>"))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 10**6))
def test_tree_spans_and_bounds_hold(n, d, seed):
    x = np.random.default_rng(seed).integers(-9, 10, (n, d))
    order, parent, edge = H.spanning_tree(x)
    assert sorted(order) == list(range(n)) and parent[0] == -1 and all(0 <= p < i for i, p in enumerate(parent) if i)
    for i in range(1, n):
        assert abs(edge[i] - np.linalg.norm(x[order[i]] - x[order[parent[i]]])) < 1e-9
    # a minimum tree by Kruskal is as long
    pairs = sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in range(n) for j in range(i))
    root, total = list(range(n)), 0.0
    for w, i, j in pairs:
        a, b = root[i], root[j]
        if a != b:
            total, root = total + w, [a if r == b else r for r in root]
    assert abs(total - edge.sum()) < 1e-6
    tree = {"vec": x[order], "aid": np.arange(n), "parent": parent, "edge": edge}
    rows = np.random.default_rng(seed + 1).integers(-9, 10, (30, d))
    exact = x[order] @ rows.T
    every_third = lambda i, low, high: (_holds(exact[i], low, high), np.arange(i % 3, 30, 3))[1]
    for i, at, scores in H._bounds(tree, rows, every_third):
        assert (scores == exact[i, at]).all()


def _holds(exact, low, high):
    assert (low <= exact).all() and (exact <= high).all()


def test_close_anchors_score_few_rows():
    """On tight clusters the bounds leave a small part of the rows to be scored again."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=64) * 30
    anchors = np.floor(centre + rng.normal(size=(20, 64)) * 0.5).astype(np.int64)
    rows = np.floor(rng.normal(size=(2000, 64)) * 30).astype(np.int64)
    order, parent, edge = H.spanning_tree(anchors)
    tree = {"aid": np.arange(20), "id": order + 10_000, "vec": anchors[order], "parent": parent, "edge": edge}
    wanted = []
    score = H._bounds
    try:
        H._bounds = lambda t, x, w: score(t, x, lambda i, lo, hi: wanted.append(w(i, lo, hi)) or wanted[-1])
        found = list(H.best_same(tree, {"id": np.arange(2000), "vec": rows}, 5))
    finally:
        H._bounds = score
    assert len(found) == 100 and sum(map(len, wanted)) < 0.1 * 20 * 2000
