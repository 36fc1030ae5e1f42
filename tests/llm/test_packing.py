import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradebook.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_tokenizers_library(library):
    encode, rng = packing.encoder(PATH), random.Random(3)
    texts = ["", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|>", "<|endoftext" + "|>" * 3, "<|endoftext|>" + "y" * 5000, "it's\n\n  x", " " * 5000, "y" * 5000, "é日本😀  z", "z " * 3000]
    texts += ["".join(rng.choice("abc DE12 \n\t.,'é日😀<|>") for _ in range(rng.randint(1, 400))) for _ in range(200)]
    for t in texts:
        assert [*encode(t).tolist(), 1] == library(t), t[:40]


def brute_best_fit(lengths, capacity):
    """Longest first into the open window with the least room that suffices."""
    room, out = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
        if not fits or lengths[i] == capacity:
            room.append(capacity)
            fits = [(capacity, len(room) - 1)]
        w = min(fits)[1]
        out[i], room[w] = w, room[w] - lengths[i]
    return sorted(room)


@pytest.mark.parametrize("seed", range(12))
def test_tree_fits_like_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 300))]
    window, offset = packing.best_fit_decreasing(np.array(lengths), capacity)
    rooms = []
    for w in range(window.max() + 1):
        at = sorted((o, n) for o, n, x in zip(offset, lengths, window, strict=True) if x == w)
        assert at[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(at, at[1:], strict=False))
        rooms.append(capacity - at[-1][0] - at[-1][1])
    assert min(rooms) >= 0
    assert sorted(rooms) == brute_best_fit(lengths, capacity)


def check(rows, docs, library, capacity):
    got, fill = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens].append(r)
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert parts[-1][0] + parts[-1][1] <= capacity
    want = defaultdict(list)
    for d in docs:
        ids = np.array(library(d.text), "<u4")
        want[d.doc_id, len(ids)].append(ids)
    assert set(want) == set(got)
    for key, ids in want.items():
        spans = sorted((r.start, r.length, r.ids_crc32) for r in got[key])
        expect = [(s, min(capacity, len(x) - s), zlib.crc32(x[s:s + capacity].tobytes())) for x in ids for s in range(0, len(x), capacity)]
        assert spans == sorted(expect)


@pytest.mark.parametrize("capacity,block", [(2048, packing.BLOCK), (64, 5)])
def test_odd_documents(odd_docs, library, capacity, block):
    rows = packing.pack(odd_docs, PATH, capacity=capacity, block=block).collect()
    check(rows, odd_docs.collect(), library, capacity)


def test_whole_table_with_little_padding(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = packing.pack(docs, PATH)
    rows = packed.collect()
    check(rows, docs.collect(), library, 2048)
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values())
    assert padding < 0.01 * sum(fill.values())


def test_sequences_hold_the_ids(odd_docs, library):
    packed = packing.pack(odd_docs, PATH, capacity=512, keep_ids=True)
    lists = [r.ids for r in packing.sequences(packed).collect()]
    assert max(map(len, lists)) <= 512
    assert sorted(i for x in lists for i in x) == sorted(i for d in odd_docs.collect() for i in library(d.text))


def test_empty_and_clashing(no_docs, clashing_docs, library):
    assert packing.pack(no_docs, PATH).count() == 0
    out = packing.pack(clashing_docs, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check(out.collect(), clashing_docs.collect(), library, 2048)
