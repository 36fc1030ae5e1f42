"""Approximate nearest neighbours along shifted Hilbert curves.

Unit vectors are projected on ``CURVES`` groups of ``DIMS`` directions of random rotations, shifted
and cut into a grid whose cells a Hilbert curve numbers.  Every curve is one ordering of all vectors,
made in Spark by range partitioning with running counts per partition.  A query looks at the rows
within a window of ranks around its own place on every curve.  Blocks of ``BLOCK`` consecutive rows
are scored against the queries whose windows touch them, the best of all blocks and curves merge, and
the final few are scored again in double precision on the original vectors.

The window is a number of ranks, fitted on all rows: ``SAMPLE_QUERIES`` sampled vectors are held against every row for their true
neighbours, and the window is the distance in ranks within which ``TARGET`` of these lie on at least one curve.  Clustered
data need a window of about a cluster, however many clusters there are, so that the work grows with the rows; data without
structure need a share of all ranks.

Equal vectors are one class.  Only the ``k + 1`` smallest ids of a class can be among anyone's k
nearest, so a class of any size costs that many rows, and equal queries are searched once.

Defined results: vectors that are null, zero, of another than the most frequent length, or hold null
or non-finite components, and rows with a null id, take no part; rows of equal id are never
neighbours of each other; ties go to the smaller id; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradebook.llm.common import join_hot, stored

CURVES, DIMS, BITS = 8, 8, 4
SAMPLE, SAMPLE_QUERIES, TARGET = 4096, 512, 0.95
BLOCK = 4096
QUERIES_AT_ONCE = 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each grid cell (n, d) on the Hilbert curve of d dimensions: from the highest bit
    down, reflect and swap axes so that every sub-cube is entered where the one before was left."""
    x = cells.astype(np.int64).T.copy()
    d, n = x.shape
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(d):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, d):                                      # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros(n, np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[d - 1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Projections, shifts and cell widths of all curves, from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.dims, self.bits = min(dims, size), bits
        need = -(-curves * self.dims // size)
        turned = np.concatenate([np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(need)], axis=1)
        self.axes = [turned[:, c * self.dims:(c + 1) * self.dims] for c in range(curves)]
        self.low, self.width = [], []
        for axes in self.axes:
            y = sample @ axes
            spread = np.maximum(y.std(axis=0), 1e-12)
            self.low.append(y.mean(axis=0) - (3 + rng.uniform(0, 1, self.dims)) * spread)   # the shift
            self.width.append(7 * spread / (1 << bits))

    def keys(self, unit: np.ndarray) -> list[np.ndarray]:
        return [hilbert_keys(np.clip(np.floor((unit @ a - low) / w), 0, (1 << self.bits) - 1), self.bits)
                for a, low, w in zip(self.axes, self.low, self.width, strict=True)]


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part; vec as array<double>."""
    x = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    x = x.where(F.col("id").isNotNull() & F.col("vec").isNotNull()
                & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                & F.exists("vec", lambda v: v != 0))
    size = x.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.where(F.size("vec") == (size["n"] if size else 0))


def true_neighbours(classes: DataFrame, asked: np.ndarray, own: np.ndarray, k: int) -> DataFrame:
    """(q, cls): the k nearest classes of each of the few vectors ``asked`` (unit, with their classes ``own``) among all, block by block."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            score = asked @ _unit(b["vec"]).T
            score[own[:, None] == b["cls"].to_numpy()] = -np.inf
            m = min(k, len(b))
            top = np.argpartition(-score, m - 1, axis=1)[:, :m]
            found = pd.DataFrame({"q": np.repeat(own, m), "cls": b["cls"].to_numpy()[top].ravel(), "near": np.take_along_axis(score, top, 1).ravel()})
            yield found[np.isfinite(found["near"])]

    best = Window.partitionBy("q").orderBy(F.desc("near"), "cls")
    found = classes.select("cls", "vec").mapInPandas(near, "q long, cls long, near double")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).select("q", "cls")


def fitted_window(ranked: DataFrame, pairs: DataFrame, target: float) -> int:
    """The ranks on either side within which ``target`` of the pairs (q, cls) lie on some curve; ``ranked``: curve, cls, rank."""
    a = ranked.select("curve", F.col("cls").alias("q"), F.col("rank").alias("at"))
    off = pairs.join(a, "q").join(ranked, ["curve", "cls"]).groupBy("q", "cls").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("off"))
    offs = off.select("off").toPandas()["off"].to_numpy()                   # SAMPLE_QUERIES * k at most
    return int(np.ceil(np.quantile(offs, target))) if len(offs) else 0


def _ranked(rows: DataFrame) -> DataFrame:
    """(curve, key, cls) rows with their rank from 0 on their curve."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(rows.repartitionByRange(n, "curve", "key", "cls").withColumn("part", F.spark_partition_id()), "curves")
    totals = rows.groupBy("part", "curve").agg(F.count("*").alias("n"))       # a row per partition and curve
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "curve", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part", "curve").orderBy("key", "cls")
    return (rows.withColumn("at", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["part", "curve"])
            .select("curve", "cls", (F.col("before") + F.col("at")).alias("rank")))


def neighbours(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
               query_every: int = 50, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest by cosine that are found for every id divisible by ``query_every``."""
    spark = table.sparkSession
    rows = usable(table, id_col, vec_col)
    smallest = Window.partitionBy("vec").orderBy("id")
    few = rows.distinct().withColumn("nth", F.row_number().over(smallest)).where(F.col("nth") <= k + 1)
    few = few.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))            # k + 1 at most
    asked = rows.where(F.col("id") % query_every == 0)
    some = asked.distinct().groupBy("vec").agg(F.count("*").alias("n_asked")).withColumn("asked", F.lit(True))
    classes = stored(few.join(some, "vec", "left").withColumn("cls", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)

    steps = 1_000_000
    picked = classes.where(F.pmod(F.xxhash64("vec"), F.lit(steps)) < max(1, steps * SAMPLE // n)) if n > SAMPLE else classes
    sample = picked.select("cls", "vec").toPandas()                                          # about SAMPLE rows at most
    if not len(sample):
        sample = classes.limit(1).select("cls", "vec").toPandas()
    sample = sample.assign(key=[tuple(v) for v in sample["vec"]]).sort_values("key")
    curves = Curves(_unit(sample["vec"]))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for c, key in enumerate(curves.keys(_unit(b["vec"]))):
                    yield pd.DataFrame({"curve": c, "key": key, "cls": b["cls"]})

    ranked = stored(_ranked(classes.select("cls", "vec").mapInPandas(keyed, "curve int, key long, cls long")), "places")
    some = sample.iloc[np.linspace(0, len(sample) - 1, min(len(sample), SAMPLE_QUERIES)).astype(int)]
    half = fitted_window(ranked, true_neighbours(classes, _unit(some["vec"]), some["cls"].to_numpy(), k), target) + 2 * k
    ranked = stored(ranked.join(classes.select("cls", "vec", "asked"), "cls"), "ranks")
    queries = ranked.where("asked").select("curve", F.explode(F.sequence(
        F.floor(F.greatest(F.col("rank") - half, F.lit(0)) / BLOCK), F.floor(F.least(F.col("rank") + half, F.lit(n - 1)) / BLOCK))).alias("block"),
        F.col("cls").alias("q"), "rank", "vec")
    # Queries that meet in one block are dealt over so many groups that a group holds about QUERIES_AT_ONCE.
    deal = max(1, -(-classes.where("asked").count() * min(n, 2 * half + BLOCK) // (n * QUERIES_AT_ONCE)))
    queries = queries.withColumn("deal", F.pmod(F.xxhash64("q"), F.lit(deal)))
    blocks = ranked.select("curve", F.floor(F.col("rank") / BLOCK).alias("block"), "cls", "rank", "vec",
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deal - 1).cast("long"))).alias("deal"))

    def scored(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(b):
            b = b.sort_values("cls")
            x, place, cls = _unit(b["vec"]).T, b["rank"].to_numpy(), b["cls"].to_numpy()
            for i in range(0, len(q), 256):
                part = q.iloc[i:i + 256]
                near = _unit(part["vec"]) @ x
                near[np.abs(part["rank"].to_numpy()[:, None] - place) > half] = -np.inf
                m = min(k + 1, len(b))
                top = np.argsort(-near, axis=1, kind="stable")[:, :m]
                found.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), m), "cls": cls[top].ravel(),
                                           "near": np.take_along_axis(near, top, 1).ravel()}))
        out = pd.concat(found) if found else pd.DataFrame({"q": [], "cls": [], "near": []})
        return out[np.isfinite(out["near"])]

    keys = ["curve", "block", "deal"]
    hits = queries.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(scored, "q long, cls long, near double")
    hits = hits.groupBy("q", "cls").agg(F.max("near").alias("near"))
    best = Window.partitionBy("q").orderBy(F.desc("near"), "cls")
    # Classes within rounding of one another may tie: keep a few more than k + 1 for the exact scores.
    hits = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= 2 * k + 2).select("q", "cls")

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    a = classes.select(F.col("cls").alias("q"), F.col("vec").alias("qv"))
    b = classes.select("cls", F.col("vec").alias("cv"), "ids")
    exact = hits.join(a, "q").join(b, "cls").select("q", "ids", (dot("qv", "cv") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("cv", "cv")))).alias("score"))
    exact = exact.select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    exact = exact.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)

    # Any number of queries may share a vector, and so a class and its answer.
    ask = join_hot(asked.distinct(), classes.where("asked").select("vec", F.col("cls").alias("q"), "n_asked"), "vec", "n_asked")
    answers = exact.groupBy("q").agg(F.collect_list(F.struct("score", "vec_id")).alias("near")).join(      # k + 1 each
        classes.where("asked").select(F.col("cls").alias("q"), "n_asked"), "q")
    out = join_hot(stored(ask.select(F.col("id").alias("query_id"), "q"), "asked"), stored(answers, "answers"), "q", "n_asked")
    out = out.select("query_id", F.explode("near").alias("x")).select("query_id", "x.score", "x.vec_id").where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
