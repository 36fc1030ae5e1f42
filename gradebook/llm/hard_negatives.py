"""Hard negatives of anchors, with score bounds along spanning trees of anchors.

The score of a row for an anchor is the inner product of their integer vectors.  An anchor's positives are its
``positives`` best rows of its own label; the negatives of a positive are the ``negatives`` best rows of other labels whose
score lies in a window below that of the positive (``low`` to ``high`` percent of it).

1. The anchors of a label are ordered along a Hilbert curve and cut into groups of at most ``TREE``; each group gets a
   minimum spanning tree of Euclidean distances, its nodes listed parents first.
2. Rows are dealt into blocks of about ``BLOCK``; each block is held by one task, and the trees are streamed past it.  At a
   tree's root all scores are computed.  At a child, a row's score lies within that at the parent, plus or minus the
   length of the edge times the norm of the row (Cauchy-Schwarz); intervals widen along unscored edges.
3. Only rows whose interval overlaps what is sought are scored again, exactly: for positives, what may reach the
   best sure ones of the block; for negatives, what may fall into the window and reach the best that surely do.
4. The best of all blocks merge.  Positives come from the blocks of the anchor's own label; their windows are attached to the
   trees, which then pass the blocks of all rows.

Every row is held against every anchor of the stated set, in blocks, if only by a bound; nothing is sampled but the
layout of the curve, which has no influence on results.  A task holds one block and one tree.

Defined results: rows whose id, label or vector is null, or whose vector holds null or non-finite components or has not the most
frequent length, take no part; a component whose floor is beyond ``common.COMPONENT`` is an error; rows equal in id, label and
vector are one row; rows of one id are never positives or negatives of each other; ties go to the smaller id, then to
any; an empty table gives no rows; other columns are not read.  Labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook.llm.ann_curves import Curves
from gradebook.llm.common import floored, join_hot, ranked, stored

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
EVERY = 50
TREE, BLOCK = 512, 1024
SAMPLE = 4096


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of ``x`` from a root on (parents first), the place of each one's parent in it (-1: root), and the
    length of the edge, of a minimum spanning tree (Prim)."""
    x = x.astype(np.float64)
    n, norms = len(x), (x * x).sum(axis=1)
    near, parent, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    order, at = [0], 0
    place = np.zeros(n, np.int64)
    edge = np.zeros(n)
    for k in range(1, n):
        done[at] = True
        far = np.maximum(norms + norms[at] - 2 * (x @ x[at]), 0)
        closer = ~done & (far < near)
        near[closer], parent[closer] = far[closer], at
        at = int(np.where(done, np.inf, near).argmin())
        place[at], edge[k] = k, np.sqrt(((x[at] - x[parent[at]]) ** 2).sum())
        order.append(at)
    return np.array(order), np.array([-1] + [place[parent[i]] for i in order[1:]], np.int64), edge


def _scorer(a: np.ndarray, x: np.ndarray):
    """Exact inner products: in double precision where every sum fits it, else in 64-bit integers."""
    most = max(1, int(np.abs(a).max())) * max(1, int(np.abs(x).max())) * a.shape[1]
    if most < 1 << 53:
        a, x = a.astype(np.float64), x.astype(np.float64)
    elif most >= 1 << 62:
        raise ValueError("scores beyond 64-bit integers")
    return lambda i, rows=slice(None): x[rows] @ a[i]


def _bounds(tree: dict, x: np.ndarray, wanted) -> Iterator:
    """Walk the tree over the rows ``x``: for node i, ``wanted(i, low, high)`` gives the rows to score from intervals that hold
    their scores; yields (i, rows, scores).  At the root all rows are scored."""
    score, norms = _scorer(tree["vec"], x), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    low, high = (np.empty((len(tree["aid"]), len(x))) for _ in range(2))
    for i, (p, edge) in enumerate(zip(tree["parent"], tree["edge"], strict=True)):
        if p < 0:
            low[i] = high[i] = score(i)
        else:
            slack = edge * norms * (1 + 1e-9) + 1                 # and what rounding may add
            low[i], high[i] = low[p] - slack, high[p] + slack
        rows = wanted(i, low[i], high[i])
        if len(rows):
            exact = score(i, rows)
            low[i, rows] = high[i, rows] = exact
            yield i, rows, exact


def _top(k: int, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _kth(k: int, values: np.ndarray) -> float:
    """The k-th largest value; -inf if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_same(tree: dict, block: dict, k: int) -> Iterator:
    """(aid, 0, id, score): each anchor's k best rows of a block of its own label."""
    ids, x = block["id"], block["vec"]

    def wanted(i, low, high):
        other = ids != tree["id"][i]
        return np.flatnonzero(other & (high >= _kth(k, low[other])))

    for i, rows, exact in _bounds(tree, x, wanted):
        for t in _top(k, ids[rows], exact):
            yield tree["aid"][i], 0, ids[rows[t]], int(exact[t])


def best_in_windows(tree: dict, block: dict, k: int) -> Iterator:
    """(aid, nth, id, score): the k best rows of other labels in the nth window of each anchor."""
    ids, x, label = block["id"], block["vec"], block["label"]
    windows = tree["windows"]

    def wanted(i, low, high):
        other = (label != tree["label"][i]) & (ids != tree["id"][i])
        need = np.zeros(len(ids), bool)
        for lo, hi in {w[1:] for w in windows[i]}:
            sure = other & (low >= lo) & (high <= hi)
            need |= other & (high >= max(lo, _kth(k, low[sure]))) & (low <= hi)
        return np.flatnonzero(need)

    for i, rows, exact in _bounds(tree, x, wanted):
        for nth, lo, hi in windows[i]:
            inside = np.flatnonzero((exact >= lo) & (exact <= hi))
            for t in inside[_top(k, ids[rows[inside]], exact[inside])]:
                yield tree["aid"][i], nth, ids[rows[t]], int(exact[t])


_SIDE = "lab long, block long, kind int, tree long, chunk long, at int, parent int, edge double, aid long, id long, label long, vec array<long>, windows array<struct<nth: int, lo: long, hi: long>>"


def _streamed(kernel, k: int):
    """Apply ``kernel`` to every tree (kind 1) and the block (kind 0) before it, in rows sorted by (lab, block, kind, tree, chunk, at)."""
    names = [c.split()[0] for c in _SIDE.split(", ", 12)]

    def joined(parts: list) -> dict:
        return {c: sum((p[c] for p in parts), []) if c == "windows" else np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = tree_of = None
        held: list = []
        tree: list = []
        block = None

        def found():
            nonlocal block, tree
            out: list = []
            if tree and held:
                block = block or joined(held)
                out = list(kernel(joined(tree), block, k))
            tree = []
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                                              ["aid", "nth", "other", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            col = {c: b.column(i) for i, c in enumerate(names)}
            long = np.stack([col[c].fill_null(0).to_numpy() for c in ("lab", "block", "kind", "tree", "chunk")], axis=1).astype(np.int64)
            vec = col["vec"].flatten().to_numpy().reshape(b.num_rows, -1)
            cuts = [0, *(np.flatnonzero((long[1:] != long[:-1]).any(axis=1)) + 1), len(long)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key, kind = tuple(long[lo, :2]), long[lo, 2]
                if tree and (key, *long[lo, 2:]) != tree_of:
                    yield found()
                if key != place:
                    place, held, block = key, [], None
                part = {c: col[c].slice(lo, hi - lo).to_numpy() for c in ("id", "label")} | {"vec": vec[lo:hi]}
                if kind == 0:
                    held.append(part)
                    continue
                part |= {c: col[c].slice(lo, hi - lo).to_numpy() for c in ("parent", "edge", "aid")}
                part["windows"] = [[(w["nth"], w["lo"], w["hi"]) for w in ws or ()] for ws in col["windows"].slice(lo, hi - lo).to_pylist()]
                tree.append(part)
                tree_of = (key, *long[lo, 2:])
        if tree:
            yield found()

    return run


def _held_against(rows: DataFrame, nodes: DataFrame, kernel, k: int) -> DataFrame:
    """(aid, nth, other, score) from blocks of ``rows`` (lab, block, ...) and the tree nodes sent to them."""
    cols = [c.split()[0] for c in _SIDE.split(", ", 12)]
    kinds = [c.split(" ", 1)[1] for c in _SIDE.split(", ", 12)]
    full = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(
        *[(F.col(c) if c in df.columns or c == "kind" else F.lit(None)).cast(t).alias(c) for c, t in zip(cols, kinds, strict=True)])
    sides = full(rows, 0).union(full(nodes.withColumn("tree", F.col("label")), 1))            # a tree: a label and a chunk
    sides = sides.repartition("lab", "block").sortWithinPartitions("lab", "block", "kind", "tree", "chunk", "at", "id")
    return sides.mapInArrow(_streamed(kernel, k), "aid long, nth int, other long, score long")


def spanning_trees(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """The anchors as stored tree nodes: chunk, at, parent, edge beside aid, id, label, vec."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(n // SAMPLE + 1)) == 0).select("vec").toPandas()["vec"].tolist()      # about SAMPLE rows
    first = rows.first()
    curve = Curves(np.array(some or [first["vec"]], np.float64), curves=1)

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = b.column(3).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve.keys(x)[0] if len(x) else np.zeros(0, np.int64))], [*b.schema.names, "key"])

    def grown(batches: Iterator) -> Iterator:
        import pandas as pd

        held = []

        def tree():
            t = pd.concat(held, ignore_index=True)
            order, parent, edge = spanning_tree(np.stack(t["vec"].tolist()))
            return t.iloc[order].assign(at=np.arange(len(t)), parent=parent, edge=edge)[["chunk", "at", "parent", "edge", "aid", "id", "label", "vec"]]

        for b in batches:
            for _, part in b.groupby(["label", "chunk"], sort=False):
                if held and tuple(held[-1][["label", "chunk"]].iloc[0]) != tuple(part[["label", "chunk"]].iloc[0]):
                    yield tree()
                    held = []
                held.append(part)
        if held:
            yield tree()

    placed = ranked(anchors.mapInArrow(keyed, "aid long, id long, label long, vec array<long>, key long"), "label", ["key", "aid"])
    placed = placed.withColumn("chunk", F.floor(F.col("rank") / TREE)).repartition("label", "chunk").sortWithinPartitions("label", "chunk", "key", "aid")
    return stored(placed.mapInPandas(grown, "chunk long, at int, parent int, edge double, aid long, id long, label long, vec array<long>"), "trees")


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", every: int = EVERY,
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id ``every`` divides."""
    label = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("_x"))
    rows = floored(rows.where("id is not null and label is not null"), "_x").drop("_x").distinct()
    rows = stored(rows, "labelled-floors")
    n = rows.count()
    if not n:
        return table.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("aid"), "id", "label", "vec")
    trees = spanning_trees(rows, stored(anchors, "anchors"))

    spread = F.xxhash64("id", "vec")
    sizes = stored(rows.groupBy("label").agg(F.count("*").alias("n")).select("label", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "label-sizes")
    own = join_hot(rows, sizes, "label", "n").select(F.col("label").alias("lab"), F.pmod(spread, F.col("blocks")).alias("block"), "id", "label", "vec")
    to_own = join_hot(trees, sizes, "label", "n").select("*", F.col("label").alias("lab"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    best = Window.partitionBy("aid", "nth").orderBy(F.desc("score"), "other")
    nth = F.row_number().over(best)
    found = _held_against(own, to_own, best_same, positives).withColumn("place", nth).where(F.col("place") <= positives)
    found = stored(found.select("aid", F.col("place").alias("nth"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # low * p <= 100 * s <= high * p in integers; a negative p leaves no s.
    window = F.struct("nth", F.expr(f"(positive_score * {low}L + 99L) div 100L").alias("lo"),
                      F.expr(f"(positive_score * {high}L) div 100L").alias("hi"))
    windows = found.where("positive_score >= 0").groupBy("aid").agg(F.sort_array(F.collect_list(window)).alias("windows"))      # ``positives`` at most
    blocks = -(-n // BLOCK)
    dealt = rows.select(F.lit(0).alias("lab"), F.pmod(spread, F.lit(blocks)).alias("block"), "id", "label", "vec")
    nodes = trees.join(windows, "aid", "left").select(
        "*", F.lit(0).alias("lab"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    mined = _held_against(dealt, nodes, best_in_windows, negatives).withColumn("place", nth).where(F.col("place") <= negatives)
    names = trees.select("aid", F.col("id").alias("anchor_id"))
    return mined.join(found, ["aid", "nth"]).join(names, "aid").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
