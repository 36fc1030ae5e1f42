"""Toxicity from class-conditional Kneser-Ney language models.

Two bigram models, toxic and ordinary, are estimated by absolute discounting and interpolation:
bigram counts, then continuation counts of the class (in how many contexts an expression occurs),
then continuation counts that both classes share.  Only expressions that clearly prefer the smaller
class (in ``DOCS`` of its documents or more, ``TIMES`` the number expected from both) have counts of
their own.  All rarer or indifferent ones are smoothed through shared counts: a word through its
longest beginning that qualifies (forms of one stem share their counts), else through one class of
words within which both models have the same distribution; a pair through its two words.

A document's statistic is the difference of the two log-likelihoods, normalised by its length.  The
statistics of labelled documents, each under models of the other folds' labels, are turned
into probabilities by monotone regression.

Fitting uses at most about ``MAX_ROWS`` labelled rows: the rarer class first, up to half of them, then the other (a fixed
share of the ids of each by hash; calibration weighs the classes as they are).  Every expression of these rows that
prefers the smaller class is kept, so the model has a bounded size whatever the corpus has; counting runs in Spark.  Scoring is a map over whole texts; no text is shuffled.

Defined results: null and empty texts have statistic 0 and the probability that goes with it;
without labels of both classes every score is the share of toxic labels (0 if there are none);
rows with a null label or id do not train; repeated rows repeat their result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.common import stored

MAX_ROWS = 20_000
DOCS, TIMES = 5, 4
STEMS = range(10, 3, -1)   # lengths of word beginnings
FOLDS = 4
#: Texts counted at a time, so that a task's counts stay small.
SLICE = 250
THRESHOLD = 0.3
WORD = r"[^\W\d_]+"
RARE, START = 0, 1   # word numbers


def words(text: str | None) -> list[str]:
    return re.findall(WORD, text.lower()) if text else []


def _pair_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start in range(0, len(b), SLICE):
            part = b.iloc[start:start + SLICE]
            n: Counter = Counter()
            first: Counter = Counter()            # the pairs by which documents first have their words
            for text, toxic, fold in zip(part["_text"], part["_toxic"], part["_fold"], strict=True):
                if not (w := words(text)):
                    continue
                pairs = list(zip([""] + w[:-1], w, [toxic] * len(w), [fold] * len(w), strict=True))
                n.update(pairs)
                first.update({p[1]: p for p in reversed(pairs)}.values())
            yield pd.DataFrame([(*k, v, first[k]) for k, v in n.items()], columns=["h", "w", "toxic", "fold", "n", "d"])


class Vocabulary:
    """Numbers of words: of the word itself, else of its longest known beginning, else RARE."""

    CACHED = 300_000

    def __init__(self, full: list[str], stems: list[str]):
        self.full = {"": START, **{w: i for i, w in enumerate(full, START + 1)}}
        self.stems = {w: i for i, w in enumerate(stems, START + 1 + len(full))}
        self.size = START + 1 + len(full) + len(stems)
        self.seen: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def numbers(self, found: list[str]) -> list[int]:
        seen = self.seen
        if len(seen) > self.CACHED:
            seen.clear()
        try:
            return [seen[w] for w in found]
        except KeyError:
            for w in found:
                if w not in seen:
                    seen[w] = self.full.get(w) or next((self.stems[w[:k]] for k in STEMS if k <= len(w) and w[:k] in self.stems), RARE)
            return [seen[w] for w in found]


class Model:
    """Log-likelihood differences by word number, history number and pair."""

    def __init__(self, vocab: Vocabulary, single: pd.DataFrame, pairs: pd.DataFrame, totals: pd.DataFrame, fold: int | None):
        """``fold``: leave this fold out.  single: w (number) and per fold and class t (contexts);
        pairs: h, w and n (count); totals: h and n."""
        keep = [f for f in range(FOLDS) if f != fold]
        of = lambda df, k, c: sum(df[f"{k}_{f}_{c}"].to_numpy(float) for f in keep)
        self.vocab, size = vocab, vocab.size
        contexts = np.zeros((2, size))
        for c in (0, 1):
            contexts[c, single["w"].to_numpy(np.int64)] = of(single, "t", c)
        shared = contexts.sum(axis=0) + 0.5                    # never zero
        shared /= shared.sum()
        uni, back, pair = np.zeros((2, size)), np.zeros((2, size)), np.zeros((2, len(pairs)))
        h, w = pairs["h"].to_numpy(np.int64), pairs["w"].to_numpy(np.int64)
        for c in (0, 1):
            t, d = contexts[c], self.discount(contexts[c])
            some, total = np.maximum(t - d, 0), max(t.sum(), 1.0)
            uni[c] = some / total + (1 - some.sum() / total) * shared
            n = of(pairs, "n", c)
            hist = np.ones(size)
            hist[totals["h"].to_numpy(np.int64)] += of(totals, "n", c)
            seen = np.maximum(n - self.discount(n), 0) / hist[h]
            back[c] = np.maximum(1 - np.bincount(h, seen, size), 1e-3)
            pair[c] = seen + back[c, h] * uni[c, w]
        log = np.log
        self.uni, self.back = (log(x[1]) - log(x[0]) for x in (uni, back))
        order = np.argsort(h * size + w)
        self.keys, self.pair = (h * size + w)[order], (log(pair[1]) - log(pair[0]))[order]

    @staticmethod
    def discount(n: np.ndarray) -> float:
        n1, n2 = (n == 1).sum(), (n == 2).sum()
        return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.75

    def statistics(self, texts) -> np.ndarray:
        """Per text: (log-likelihood under toxic - under ordinary) / words."""
        out, size = np.zeros(len(texts)), self.vocab.size
        for i, text in enumerate(texts):
            found = words(text)
            if not found:
                continue
            w = np.array(self.vocab.numbers(found), np.int64)
            h = np.empty_like(w)
            h[0], h[1:] = START, w[:-1]
            delta = self.uni[w] + self.back[h]
            if len(self.keys):
                keys = h * size + w
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                delta = np.where(self.keys[at] == keys, self.pair[at], delta)
            out[i] = delta.mean()
        return out


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a rising curve through the weighted means of ``y`` along ``x``."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []            # sums of y, of x and of weights
    for a, b, w in zip(x[order], y[order], weight[order], strict=True):
        blocks.append([b * w, a * w, w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            s, t, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += t
            blocks[-1][2] += n
    sums = np.array(blocks)
    return sums[:, 1] / sums[:, 2], (sums[:, 0] + 0.05) / (sums[:, 2] + 1)


class Scorer:
    """A model with its calibration curve; ``model`` None: a constant."""

    def __init__(self, model: Model | None, x: np.ndarray, p: np.ndarray):
        self.model, self.x, self.p = model, x, p

    def scores(self, texts) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), float(self.p[0]))
        s = self.model.statistics(texts)
        # Outside the knots and along flat parts a slight slope keeps the order of the statistics.
        return np.clip(np.interp(s, self.x, self.p) + 1e-3 * np.tanh(s), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_rows: int = MAX_ROWS) -> Scorer:
    """Fit on the labelled documents of ``labels`` (id, label 0 or 1)."""
    spark = docs.sparkSession
    lab = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_key"), F.col(label_col).cast("int").alias("_toxic"), F.xxhash64(id_col).alias("_hash"))
    n = lab.groupBy("_toxic").count().collect()
    n = {r["_toxic"]: r["count"] for r in n}
    if len(n) < 2:
        return Scorer(None, np.zeros(1), np.array([float(1 in n)]))
    steps = 1_000_000
    few, many = sorted(n, key=lambda c: (n[c], -c))
    take = {few: min(n[few], max_rows // 2)}
    take[many] = min(n[many], max_rows - take[few])
    share = {c: min(steps, -(-steps * take[c] // n[c])) for c in n}
    lab = lab.where(F.pmod("_hash", F.lit(steps)) < F.when(F.col("_toxic") == 1, share[1]).otherwise(share[0])).withColumn(
        "_fold", F.pmod(F.shiftright("_hash", 32), F.lit(FOLDS)).cast("int"))
    # The sample has about max_rows ids at most, one row each (a text with both labels counts as toxic), so it can be broadcast:
    # no text is shuffled.
    lab = lab.groupBy("_key", "_fold").agg(F.max("_toxic").alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(
        F.broadcast(lab.select("_key", "_toxic", "_fold")), "_key")
    rows = stored(rows, "toxicity-sample")
    counts = rows.select("_text", "_toxic", "_fold").mapInPandas(_pair_counts, "h string, w string, toxic int, fold int, n long, d long")
    counts = stored(counts.groupBy("h", "w", "toxic", "fold").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "toxicity-pairs")

    sums = counts.groupBy("toxic").agg(F.sum("n").alias("n")).collect()
    sums = {r["toxic"]: r["n"] for r in sums}
    if len(sums) < 2:
        return Scorer(None, np.zeros(1), np.array([n[1] / sum(n.values())]))
    less = min(sums, key=sums.get)                             # the smaller class
    part = sums[less] / sum(sums.values())

    def telling(df: DataFrame, docs_col: str, *keys: str) -> pd.DataFrame:
        """The expressions that prefer the smaller class; as many as the bounded sample has."""
        out = df.groupBy(*keys).agg(F.sum(F.when(F.col("toxic") == less, F.col(docs_col)).otherwise(0)).alias("seen"),
                                    (F.sum(docs_col) * part).alias("expected"))
        out = out.where((F.col("seen") >= DOCS) & (F.col("seen") >= F.col("expected") * min(TIMES, 0.8 / part)))
        return out.orderBy(F.desc("seen"), *keys).select(*keys).toPandas()

    by_word = counts.groupBy("w", "toxic").agg(F.sum("d").alias("d"))
    full = telling(by_word, "d", "w")
    rare = by_word.join(F.broadcast(spark.createDataFrame(full, "w string")), "w", "left_anti")
    stem = F.explode(F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda k: k <= F.length("w")), lambda k: F.substring("w", F.lit(1), k)))
    vocab = Vocabulary(full["w"].tolist(), telling(rare.select(stem.alias("w"), "toxic", "d"), "d", "w")["w"].tolist())

    def numbered(batches):
        for b in batches:
            yield pd.DataFrame({"h": vocab.numbers(["" if x is None else x for x in b["h"]]), "w": vocab.numbers(b["w"].tolist()),
                                "toxic": b["toxic"], "fold": b["fold"], "n": b["n"]})

    mapped = counts.mapInPandas(numbered, "h long, w long, toxic int, fold int, n long")
    mapped = stored(mapped.groupBy("h", "w", "toxic", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("t")), "toxicity-numbers")

    def per_cell(df: DataFrame, k: str, *keys: str) -> pd.DataFrame:
        cells = [(f, c) for f in range(FOLDS) for c in (0, 1)]
        return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == c), F.col(k))), F.lit(0)).alias(f"{k}_{f}_{c}")
                                       for f, c in cells]).toPandas()

    some = F.broadcast(spark.createDataFrame(telling(mapped, "n", "h", "w"), "h long, w long"))
    tables = per_cell(mapped, "t", "w"), per_cell(mapped.join(some, ["h", "w"]), "n", "h", "w"), per_cell(mapped, "n", "h")
    halves = [Model(vocab, *tables, f) for f in range(FOLDS)]

    def held(batches):
        for b in batches:
            s = np.zeros(len(b))
            for f in range(FOLDS):
                at = (b["_fold"] == f).to_numpy()
                s[at] = halves[f].statistics(b["_text"][at].tolist())
            yield pd.DataFrame({"x": s, "y": b["_toxic"].astype(float)})

    seen = rows.select("_text", "_toxic", "_fold").mapInPandas(held, "x double, y double").toPandas()  # about max_rows rows
    y = seen["y"].to_numpy()
    return Scorer(Model(vocab, *tables, None), *monotone(seen["x"].to_numpy(), y, np.where(y == 1, steps / share[1], steps / share[0])))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic class of its whole text as ``name`` (in place of a column of that name)."""
    from pyspark.sql import types as T

    docs = docs.drop(name)

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            # To Python in slices: a batch may hold very long texts.
            texts = b.column(text_col)
            s = [scorer.scores(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(s) if s else np.zeros(0))], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)
