"""Toxicity and language identification: held-out accuracy, gradients and odd inputs."""

import numpy as np
import pytest

from gradebook.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_backpropagation_equals_finite_differences():
    net = language_id.BiGRU(["a", "b", "c"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, length, y = rng.integers(0, 256, (5, 7)), np.array([5, 3, 1, 4, 5, 2, 5]), np.array([0, 1, 2, 0, 1, 2, 0])
    _, grad = net.loss_and_gradients(x, length, y)
    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        rows = [int(x[0, 0]) * 9 + 4] if name.startswith("W") else range(min(6, flat.size))
        for i in rows:
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = net.loss_and_gradients(x, length, y)[0]
            flat[i] = old - eps
            down = net.loss_and_gradients(x, length, y)[0]
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-6, name


def test_padding_does_not_change_a_window():
    net = language_id.BiGRU(["a", "b"], hidden=4)
    wins = [b"abc", b"de", b"abcdefgh", b"q"]
    together = net.label(wins)
    assert np.allclose(together, np.concatenate([net.label([w]) for w in wins]), atol=1e-6)
    assert np.allclose(together.sum(axis=1), [len(w) for w in wins], atol=1e-4)


def test_windows_cover_every_byte_but_white_space():
    text = "Ab c\t" + "é" * 40 + "\n\n  z"
    assert b"".join(language_id.windows(text)) == "".join(text.lower().split()).encode()


@pytest.fixture(scope="module")
def languages(spark):
    return queries.op4_language_id(spark, SF).toPandas()


def test_languages_of_held_out_documents(spark, languages):
    import zlib
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = languages.merge(docs, on="doc_id")
    assert len(both) == len(docs) == len(languages)
    assert (both["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both["doc_id"]]).all()
    held = both[both["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert both["score"].between(0, 1).all()


def test_odd_texts_have_languages(spark, odd_docs, no_docs, clashing_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    net = language_id.train(docs.union(odd_docs.select(*docs.columns)))
    rows = language_id.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (0 < r.score <= 1 if letters else r.score == 0)
    out = language_id.predict(clashing_docs, net)
    assert sorted(out.columns) == sorted(clashing_docs.columns) and out.count() == clashing_docs.count()
    assert language_id.train(no_docs) is None
    assert language_id.predict(no_docs, net).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, None).collect()} == {"und"}


def test_monotone_regression_pools_violators():
    x, p = toxicity.monotone(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]), np.ones(4))
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()


def test_kneser_ney_by_hand():
    """Two words, no pairs: probabilities follow from the contexts by hand."""
    import pandas as pd
    vocab = toxicity.Vocabulary(["bad"], [])
    cells = [(f, c) for f in range(toxicity.FOLDS) for c in (0, 1)]
    single = pd.DataFrame({"w": [toxicity.RARE, toxicity.START + 1], **{f"t_{f}_{c}": [90, 10 if c else 0] if f == 0 else [0, 0] for f, c in cells}})
    none = pd.DataFrame({"h": [], "w": [], **{f"n_{f}_{c}": [] for f, c in cells}})
    model = toxicity.Model(vocab, single, none, none, None)
    shared = np.array([180.5, 0.5, 10.5]) / 191.5
    p1 = np.array([89.25, 0, 9.25]) / 100 + 1.5 / 100 * shared
    p0 = np.array([89.25, 0, 0]) / 90 + 0.75 / 90 * shared
    assert np.allclose(model.uni, np.log(p1) - np.log(p0))
    assert np.allclose(model.statistics(["bad bad thing", "", None])[1:], 0)
    want = (2 * model.uni[2] + model.uni[0]) / 3
    assert np.isclose(model.statistics(["Bad, bad thing"])[0], want)


def test_monotone_regression_weighs_rows():
    """A row of weight 3 counts as three equal rows, but for the prior of the mean."""
    many = toxicity.monotone(np.array([1.0, 2.0, 2.0, 2.0]), np.array([1.0, 0.0, 0.0, 0.0]), np.ones(4))
    once = toxicity.monotone(np.array([1.0, 2.0]), np.array([1.0, 0.0]), np.array([1.0, 3.0]))
    assert np.allclose(many, once)


@pytest.mark.parametrize("fold", [None, 1])
def test_kneser_ney_with_pairs_by_brute_force(fold):
    """Both class models from their definition: discounted pairs of some histories, continuation counts below, shared ones below those."""
    import random
    from collections import Counter
    import pandas as pd
    rng, size = random.Random(5), 7
    vocab = toxicity.Vocabulary([f"w{chr(97 + i)}" for i in range(size - 2)], [])
    assert vocab.size == size
    texts = [(rng.randrange(toxicity.FOLDS), rng.randrange(2), [rng.choice([0, 2, 2, 3, 4, 5, 6]) for _ in range(rng.randint(1, 12))]) for _ in range(80)]
    pairs = Counter((f, c, h, w) for f, c, t in texts for h, w in zip([toxicity.START, *t], t, strict=False))
    known = [(h, w) for h in range(size) for w in range(size) if (h + w) % 2 == 0]
    cells = [(f, c) for f in range(toxicity.FOLDS) for c in (0, 1)]

    def table(keys, value, name, index):
        return pd.DataFrame([{**dict(zip(index, k if isinstance(k, tuple) else (k,), strict=True)), **{f"{name}_{f}_{c}": value(f, c, k) for f, c in cells}} for k in keys])

    contexts = lambda f, c, w: sum(1 for x in pairs if x[0] == f and x[1] == c and x[3] == w)
    count = lambda f, c, k: pairs[f, c, *k]
    total = lambda f, c, h: sum(n for x, n in pairs.items() if x[:3] == (f, c, h))
    model = toxicity.Model(vocab, table(range(size), contexts, "t", ["w"]), table(known, count, "n", ["h", "w"]), table(range(size), total, "n", ["h"]), fold)

    folds = [f for f in range(toxicity.FOLDS) if f != fold]
    own = {c: [sum(contexts(f, c, w) for f in folds) for w in range(size)] for c in (0, 1)}
    shared = [own[0][w] + own[1][w] + 0.5 for w in range(size)]
    shared = [x / sum(shared) for x in shared]

    def discount(values):
        n1, n2 = values.count(1), values.count(2)
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def probability(c, h, w):
        d, all_ = discount(own[c]), max(sum(own[c]), 1)
        less = [max(x - d, 0) for x in own[c]]
        low = less[w] / all_ + (1 - sum(less) / all_) * shared[w]
        n = {k: sum(count(f, c, k) for f in folds) for k in known}
        e, history = discount(list(n.values())), 1 + sum(total(f, c, h) for f in folds)
        left = max(1 - sum(max(n[k] - e, 0) for k in known if k[0] == h) / history, 1e-3)
        return max(n.get((h, w), 0) - e, 0) / history + left * low if (h, w) in n else left * low

    for _, _, t in texts[:20]:
        want = np.mean([np.log(probability(1, h, w) / probability(0, h, w)) for h, w in zip([toxicity.START, *t], t, strict=False)])
        got = model.statistics([" ".join("zz" if w == 0 else vocab_word(vocab, w) for w in t)])[0]
        assert np.isclose(got, want)


def vocab_word(vocab, number):
    return next(w for w, i in vocab.full.items() if i == number)


def test_the_rarer_class_is_sampled_first(spark):
    """40 toxic rows among 4,000: a bound of 100 rows takes all 40, and a clean text still scores low."""
    rows = [(i, "rotten " * 5 + f"word{i % 7} other" if i < 40 else f"a plain text word{i % 7} and other words", int(i < 40)) for i in range(4000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] * 2, "doc_id long, toxic int")          # each label twice
    scorer = toxicity.fit(docs, labels, max_rows=100)
    bad, good = scorer.scores(["rotten rotten word1", "a plain text word2 and other words"])
    assert bad > 0.5 and good < 0.1


def test_every_language_is_learned(spark):
    """A language of three documents beside large ones is learned."""
    few = [(i, t, "xx") for i, t in enumerate(["zqzq vxvx kkzz qqvv zzxx " * 8] * 3)]
    docs = spark.createDataFrame(few, "doc_id long, text string, lang string").union(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100", "text", "lang"))
    net = language_id.train(docs)
    assert "xx" in net.langs
    ask = spark.createDataFrame([(1, "zqzq kkzz vxvx zzxx")], "doc_id long, text string")
    assert language_id.predict(ask, net).first().lang_pred == "xx"


@pytest.fixture(scope="module")
def toxic(spark):
    return queries.op6_toxicity(spark, SF).toPandas()


def test_toxicity_of_held_out_documents(spark, toxic):
    import zlib
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").toPandas()
    assert (toxic["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in toxic["doc_id"]]).all()
    assert toxic["score"].between(0, 1).all() and (toxic["predicted"] == (toxic["score"] >= 0.3)).all()
    held = toxic[toxic["held_out"]].merge(labels, on="doc_id")
    rank, yes = held["score"].rank(), held["toxic"] == 1
    auc = (rank[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())
    assert auc > 0.95
    assert (held["predicted"] == held["toxic"]).mean() > 0.95


def test_odd_texts_have_scores(spark, odd_docs, no_docs, clashing_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, scorer).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    out = toxicity.score(clashing_docs, scorer)
    assert sorted(out.columns) == sorted(clashing_docs.columns) and out.count() == clashing_docs.count()
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.limit(0))).collect()} == {0.0}
    only = labels.where("toxic = 1")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, only)).collect()} == {1.0}
