"""Language identification by a bidirectional gated recurrent network over bytes.

A window is a run of lower-cased UTF-8 bytes without white space, at most ``WINDOW`` bytes long;
longer runs are cut into several.  Two gated recurrent layers read each window forwards and
backwards, and a softmax layer labels every byte position with language probabilities from both
states.  A document's probabilities are the mean over all positions of its whole text.

The network is trained in numpy by backpropagation through time on a bounded sample: at most about
``DOCS_PER_LANG`` documents a language and ``MAX_DOCS`` in all (a fixed share of the ids by hash) and ``WINDOWS_PER_DOC``
windows spread evenly over each whole text; languages weigh the same, and a step grows with their number.  Labelling is a map over the
input: a task labels each distinct window once, keeps up to ``CACHE`` of them, and adds up the
windows of each text.  No text is shuffled.

The softmax knows the trained languages only.  A ``Gate`` rejects texts of none: byte trigrams of the
same sample give every text a mean log-likelihood, and a text below the floor of its predicted language
is ``und``.  Floors come from the labelled documents' own values, each under the other half's trigrams.

Defined results: a null text or one without a letter is ``und`` with score 0; without training rows
every text is; of equal probabilities the first language in order wins; repeated rows repeat their
result; rows with a null language or id do not train.  Every other language is learned, however rare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 24
HIDDEN = 10
DOCS_PER_LANG = 800
#: Documents in the sample of all languages; with more than MAX_DOCS / DOCS_PER_LANG languages each has an equal part, one at least.
MAX_DOCS = 20_000
WINDOWS_PER_DOC = 48
STEPS, BATCH, RATE = 160, 768, 0.02
#: Windows of each language in a step, at least.
LEAST = 48
CACHE = 200_000
#: The gate: codes of bytes, bytes of the language's usual value added to every text, and the floor's distance
#: below the median of the labelled documents, in distances from the median to the lowest hundredth.
CODES, PRIOR, SPREAD = 128, 64, 3
UNKNOWN = "und"


def windows(text: str) -> list[bytes]:
    out = []
    for w in text.lower().encode("utf-8", "replace").split():
        if len(w) <= WINDOW:
            out.append(w)
        else:
            out.extend(w[i:i + WINDOW] for i in range(0, len(w), WINDOW))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class BiGRU:
    """Parameters: per direction a byte table W (256, 3H) and a recurrence U (H, 3H) with gate order
    update, reset, candidate; the candidate's recurrent bias c (H); the output V (2H, K) and b (K)."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden, k = langs, hidden, len(langs)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["W" + d] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, hidden ** -0.5, (hidden, 3 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(hidden, np.float32)
        self.p["V"] = rng.normal(0, 0.3, (2 * hidden, k)).astype(np.float32)
        self.p["b"] = np.zeros(k, np.float32)

    def _run(self, d: str, x: np.ndarray, keep: bool = False):
        """States (T, B, H) of one direction over bytes x (T, B)."""
        hid, u, c = self.hidden, self.p["U" + d], self.p["c" + d]
        h = np.zeros((x.shape[1], hid), u.dtype)
        out, tape = np.empty((*x.shape, hid), u.dtype), []
        for t in range(len(x)):
            a, g = self.p["W" + d][x[t]], h @ u
            zr = _sigmoid(a[:, :2 * hid] + g[:, :2 * hid])
            z, r, gc = zr[:, :hid], zr[:, hid:], g[:, 2 * hid:] + c
            n = np.tanh(a[:, 2 * hid:] + r * gc)
            if keep:
                tape.append((h, z, r, gc, n))
            h = n + z * (h - n)
            out[t] = h
        return out, tape

    def _back(self, d: str, x: np.ndarray, tape: list, dout: np.ndarray, grad: dict) -> None:
        """Backpropagation through time; adds this direction's gradients to ``grad``."""
        hid, u = self.hidden, self.p["U" + d]
        du, dc, dw = np.zeros_like(u), np.zeros(hid, u.dtype), np.empty((*x.shape, 3 * hid), u.dtype)
        dh = np.zeros_like(dout[0])
        for t in range(len(x) - 1, -1, -1):
            h, z, r, gc, n = tape[t]
            dh = dh + dout[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz, dr = dh * (h - n) * z * (1 - z), dn * gc * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dw[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ dg
            dc += dg[:, 2 * hid:].sum(axis=0)
            dh = dh * z + dg @ u.T
        onehot = np.zeros((x.size, 256), u.dtype)
        onehot[np.arange(x.size), x.ravel()] = 1
        grad["W" + d], grad["U" + d], grad["c" + d] = onehot.T @ dw.reshape(-1, 3 * hid), du, dc

    def loss_and_gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray):
        """Mean cross entropy over all positions; x: (T, B) bytes, ends padded; y: language numbers."""
        steps, batch = x.shape
        at = np.arange(steps)[:, None]
        inside = at < length
        turn = np.where(inside, length - 1 - at, at)           # reverses each window within its length
        cols = np.arange(batch)
        xb = x[turn, cols]
        hf, tf = self._run("f", x, True)
        hb, tb = self._run("b", xb, True)
        hb = hb[turn, cols]
        both = np.concatenate([hf, hb], axis=2)
        logits = both @ self.p["V"] + self.p["b"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        n = inside.sum()
        loss = -(np.log(prob[:, cols, y] + 1e-9) * inside).sum() / n
        dl = prob.copy()
        dl[:, cols, y] -= 1
        dl *= (inside / n)[..., None].astype(prob.dtype)
        grad = {"V": both.reshape(-1, both.shape[2]).T @ dl.reshape(-1, dl.shape[2]), "b": dl.sum(axis=(0, 1))}
        dboth = dl @ self.p["V"].T
        self._back("f", x, tf, dboth[..., :self.hidden], grad)
        self._back("b", xb, tb, dboth[..., self.hidden:][turn, cols], grad)
        return loss, grad

    def train(self, wins: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 7) -> None:
        """Adam over batches that draw every language equally often."""
        rng = np.random.default_rng(seed)
        x = np.zeros((len(wins), WINDOW), np.uint8)
        length = np.array([len(w) for w in wins])
        x[np.arange(WINDOW) < length[:, None]] = np.frombuffer(b"".join(wins), np.uint8)
        rows = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(r, max(LEAST, batch // len(rows))) for r in rows])
            top = length[pick].max()
            _, grad = self.loss_and_gradients(x[pick, :top].T, length[pick], y[pick])
            lr = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.99 ** step)) + 1e-8)).astype(self.p[k].dtype)

    def label(self, wins: list[bytes]) -> np.ndarray:
        """Per window the sum of its positions' language probabilities (n, K)."""
        out = np.zeros((len(wins), len(self.langs)), np.float32)
        length = np.array([len(w) for w in wins])
        for n in np.unique(length):                            # windows of one length need no padding
            rows = np.flatnonzero(length == n)
            for i in range(0, len(rows), 4096):
                part = rows[i:i + 4096]
                x = np.frombuffer(b"".join([wins[j] for j in part]), np.uint8).reshape(len(part), n).T
                hf, hb = self._run("f", x)[0], self._run("b", x[::-1])[0][::-1]
                logits = hf @ self.p["V"][:self.hidden] + hb @ self.p["V"][self.hidden:] + self.p["b"]
                prob = np.exp(logits - logits.max(axis=2, keepdims=True))
                out[part] = (prob / prob.sum(axis=2, keepdims=True)).sum(axis=0)
        return out


class Gate:
    """Whether a text is like the labelled ones: trigrams over the most frequent bytes, and a floor for each language."""

    def __init__(self, rows):
        """rows: lang, doc, win of the sample."""
        some = np.bincount(np.frombuffer(b"".join(rows["win"]), np.uint8), minlength=256)
        self.code = np.full(256, CODES - 1)                    # 0: before the window; the last: all other bytes
        self.code[np.argsort(-some, kind="stable")[:CODES - 2]] = np.arange(1, CODES - 1)
        half, floors = (rows["doc"] & 1).to_numpy(), {}
        value, size = np.zeros(len(rows)), rows["win"].map(len).to_numpy()
        for h in (0, 1):
            if (half == h).any():
                self._learn(rows["win"][half != h].tolist())
                value[half == h] = self.sums(rows["win"][half == h].tolist())
        by = rows[["lang", "doc"]].assign(value=value, size=size).groupby(["lang", "doc"]).sum()
        for lang, x in by.groupby(level="lang"):
            usual = float((x["value"] / x["size"]).median())
            low, mid = np.quantile((x["value"] + PRIOR * usual) / (x["size"] + PRIOR), [0.01, 0.5])
            floors[lang] = usual, mid - SPREAD * (mid - low)
        self.floors = floors
        self._learn(rows["win"].tolist())

    def _places(self, wins: list[bytes]):
        """(rows, trigram numbers (rows, n)) of the windows of each length."""
        length = np.array([len(w) for w in wins], np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            x = np.zeros((len(at), n + 2), np.int64)
            x[:, 2:] = self.code[np.frombuffer(b"".join([wins[i] for i in at]), np.uint8)].reshape(len(at), n)
            yield at, (x[:, :-2] * CODES + x[:, 1:-1]) * CODES + x[:, 2:]

    def _learn(self, wins: list[bytes]) -> None:
        count = np.zeros(CODES ** 3)
        for _, x in self._places(wins):
            count += np.bincount(x.ravel(), minlength=CODES ** 3)
        three = count.reshape(CODES, CODES, CODES)
        p = np.full(CODES, 1 / CODES)
        for n in (three.sum(axis=(0, 1)), three.sum(axis=0), three):   # each order is smoothed by the one below
            kinds = (n > 0).sum(axis=-1, keepdims=True) + 1
            p = (n + kinds * p) / (n.sum(axis=-1, keepdims=True) + kinds)
        p[..., -1] /= 256 - (CODES - 2)
        self.log = np.log(p).astype(np.float32).ravel()

    def sums(self, wins: list[bytes]) -> np.ndarray:
        """Per window the log-likelihood of its bytes."""
        out = np.zeros(len(wins), np.float32)
        for at, x in self._places(wins):
            out[at] = self.log[x].sum(axis=1)
        return out

    def passes(self, lang: str, value: float, size: int) -> bool:
        usual, floor = self.floors[lang]
        return (value + PRIOR * usual) / (size + PRIOR) >= floor - 1e-6


class Labeller:
    """Document probabilities; labels each distinct window once while it is in the cache."""

    def __init__(self, net: BiGRU | None, gate: Gate | None = None):
        self.net, self.gate = net, gate
        self.row: dict[bytes, int] = {}
        self.prob = np.zeros((0, len(net.langs) + (gate is not None) if net else 0), np.float32)
        self.used = 0

    def _know(self, wins: set[bytes]) -> None:
        new = [w for w in wins if w not in self.row]
        if len(self.row) + len(new) > CACHE:
            self.row, self.used = {}, 0
            new = list(wins)
        if self.used + len(new) > len(self.prob):
            grown = np.zeros((max(2 * len(self.prob), self.used + len(new)), self.prob.shape[1]), np.float32)
            grown[:self.used] = self.prob[:self.used]
            self.prob = grown
        self.prob[self.used:self.used + len(new), :len(self.net.langs)] = self.net.label(new)
        if self.gate:
            self.prob[self.used:self.used + len(new), -1] = self.gate.sums(new)
        self.row.update(zip(new, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.net is None:
            return langs, scores
        wins = {i: windows(t) for i, t in enumerate(texts) if t and re.search(r"[^\W\d_]", t)}
        self._know(set().union(*wins.values()) if wins else set())
        for i, ws in wins.items():
            total = self.prob[[self.row[w] for w in ws]].sum(axis=0, dtype=np.float64)
            size = sum(map(len, ws))
            share = total[:len(self.net.langs)] / size
            best = int(share.argmax())
            if self.gate and not self.gate.passes(self.net.langs[best], total[-1], size):
                continue
            langs[i], scores[i] = self.net.langs[best], float(min(1.0, max(0.0, share[best])))
        return langs, scores


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """(lang, doc, win) windows of the bounded sample of the documents with a language, as a pandas table; None without any."""
    docs = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    docs = docs.where("_key is not null and _lang is not null")
    n = docs.groupBy("_lang").count().orderBy("_lang").collect()               # a row a language, as the network's output
    if not n:
        return None
    steps = 1_000_000
    each = min(DOCS_PER_LANG, max(1, MAX_DOCS // len(n)))
    share = F.create_map(*[F.lit(x) for r in n for x in (r["_lang"], min(steps, -(-steps * each // r["count"])))])

    def cut(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for lang, doc, text in zip(b["_lang"], b["_doc"], b["_text"], strict=True):
                ws = windows(text or "")
                out += [(lang, doc, ws[i]) for i in sorted({int(j) for j in np.linspace(0, len(ws) - 1, WINDOWS_PER_DOC)})] if ws else []
            yield pd.DataFrame(out, columns=["lang", "doc", "win"])

    rows = docs.where(F.pmod(F.xxhash64("_key"), F.lit(steps)) < share[F.col("_lang")]).select("_lang", F.xxhash64("_key").alias("_doc"), "_text")
    rows = rows.mapInPandas(cut, "lang string, doc long, win binary").toPandas()   # bounded by the two parameters
    rows["win"] = rows["win"].map(bytes)
    rows = rows.sort_values(["lang", "win", "doc"])         # whatever order the tasks came in
    return rows if len(rows) else None


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> BiGRU | None:
    """Train on the documents with a language; None without any."""
    return fit(sample(docs, id_col, text_col, lang_col))


def fit(rows) -> BiGRU | None:
    """Train on the windows of ``sample``."""
    if rows is None:
        return None
    langs = sorted(set(rows["lang"]))
    net = BiGRU(langs)
    net.train(rows["win"].tolist(), rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy())
    return net


def predict(docs: DataFrame, net: BiGRU | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score", gate: Gate | None = None) -> DataFrame:
    """``docs`` with the predicted language of its whole text and its probability (in place of columns of those names)."""
    from pyspark.sql import types as T

    docs = docs.drop(lang, score)

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        labeller = Labeller(net, gate)
        for b in batches:
            texts, langs, scores = b.column(text_col), [], []
            for i in range(0, len(texts), 512):             # in slices: a batch may hold very long texts
                x, y = labeller.predict(texts.slice(i, 512).to_pylist())
                langs, scores = langs + x, scores + y
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names, lang, score])

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
