import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from gradebook.llm import piece_tokens as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    pieces = P.Pieces(PATH)
    return P.Encoder(pieces), P.Decoder(pieces)


def test_model_file(library):
    p = P.Pieces(PATH)
    assert p.text == [library.id_to_piece(i) for i in range(library.get_piece_size())]
    assert np.allclose(p.score, [library.get_score(i) for i in range(len(p.text))])


def test_suffix_order_and_ranges(coder):
    e, text = coder[0], "the theatre there\0hethe ththe\0"
    t = e.points[[ord(c) for c in text]] * (np.array(list(text)) != "\0")
    order = e.suffixes(t)
    keys = [tuple(t[i:i + e.longest]) for i in order]
    assert keys == sorted(keys) and sorted(order) == list(range(len(t)))
    low, high = e.ranges(t, order)
    for row in np.flatnonzero(high > low):
        want = tuple(e.chars[row, :e.size[row]])
        assert sorted(order[low[row]:high[row]]) == [i for i in range(len(t)) if tuple(t[i:i + len(want)]) == want]
    found = {tuple(e.chars[r, :e.size[r]]) for r in np.flatnonzero(high > low)}
    every = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 2, min(len(t), i + e.longest) + 1)}
    assert found == every & {tuple(e.chars[r, :e.size[r]]) for r in range(len(e.piece))}


def test_ids_and_texts_equal_the_library(coder, library):
    encoder, decoder = coder
    rng = random.Random(2)
    texts = ["", " ", "  two  spaces ", "\n\t\r\n", "a" * 1000, "ab" * 900 + " x", "日本" * 300, " " * 70, "😀①\x00<s></s><0x41>", "ﬁ é é ﻿​"]
    texts += ["".join(rng.choice("abcdefghi tre\n éß.,0123日本①") for _ in range(rng.randint(1, 900))) for _ in range(200)]
    for t, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t), t[:50]
        assert decoder.decode(ids.tolist()) == library.decode(ids.tolist()) == t, t[:50]


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = P.decode(P.encode(docs, PATH), PATH).collect()
    assert [r.ids for r in rows] == [library.encode(r.text) for r in rows]
    assert all(r.decoded == r.text for r in rows)


def test_odd_empty_and_clashing(spark, odd_docs, no_docs, clashing_docs):
    rows = P.decode(P.encode(odd_docs, PATH), PATH).collect()
    assert len(rows) == odd_docs.count() and all(r.decoded == r.text for r in rows)
    assert all((r.ids is None) == (r.text is None) for r in rows)
    assert P.decode(P.encode(no_docs, PATH), PATH).count() == 0
    assert P.encode(clashing_docs, PATH, ids_col="kept").count() == clashing_docs.count()
    ids = spark.createDataFrame([([0, 1, None, 40000, -1, 272],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in P.decode(ids, PATH).collect()] == [P.Decoder(P.Pieces(PATH)).decode([272]), None, ""]


def test_the_sign_for_a_blank_becomes_one(coder):
    encoder, decoder = coder
    assert decoder.decode(encoder.encode(["a▁b"])[0].tolist()) == "a b"
