"""Packing token sequences by best-fit decreasing.

Every document becomes its token ids and an end id.  A document of at least ``capacity`` ids is
first cut into full windows; what is left is one piece shorter than the capacity.  Pieces go, longest
first, into the open window with the tightest remaining capacity that still holds them; a segment
tree over the remaining capacities finds it in log2(capacity) steps, and a new window opens if none fits.

Tokenizing is a map over the input.  Only pieces (ids, spans, checksums; with ``keep_ids`` the token
ids too) are shuffled, dealt evenly by a running number, so neither a hot key nor a long document
gathers in one task.  A task packs blocks of at most ``block`` pieces, so its memory is bounded at
any input size; a block leaves few windows partly filled.

Defined results: a null or empty text is the end id alone; a text of any length is cut into windows; pieces of equal length
go in the order of the running number; repeated rows and ids, null ids included,
are packed row by row; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
BLOCK = 200_000
#: Longer runs without (or of) white space go through the ``tokenizers`` library, whose time does
#: not grow with the square of a run.
LONG_RUN = 2000


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the byte-level BPE in a ``tokenizers`` file, its special strings as their own ids.

    The file's vocabulary in merge order is a rank table, which ``tiktoken`` applies five times
    faster with the same result; the file's own library takes the texts with very long runs.
    """
    import re

    import public_tokenizers
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    blank, slow = re.compile(r"\s{%d}" % LONG_RUN), []

    def encode(text: str) -> np.ndarray:
        if len(text) > LONG_RUN and (max(map(len, text.split()), default=0) > LONG_RUN or blank.search(text)):
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(path))
            return np.asarray(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens (and ids), with a running number to deal them by."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, n = encoder(tokenizer), TaskContext.get().partitionId() * 7919
        for batch in batches:
            rows, ids = [], []
            keys = batch.column(0)
            for at, text in enumerate(batch.column(1)):
                doc = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(doc), capacity):
                    piece, n = doc[start:start + capacity], n + 1
                    rows.append((at, start, len(piece), zlib.crc32(piece), len(doc), n))
                    if keep_ids:
                        ids.append(piece.astype(np.int32))
            cols = np.array(rows, np.int64).reshape(-1, 6).T
            out = [keys.take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []),
                                             [id_col, "start", "length", "ids_crc32", "doc_tokens", "_n", *["ids"] * keep_ids])

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, _n long" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pieces, schema)


class CapacityTree:
    """Open windows by remaining capacity: a segment tree tells which capacities have a window."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, window: int, remaining: int) -> None:
        self.open[remaining].append(window)
        k, some = self.leaves + remaining, self.some
        while k and not some[k]:
            some[k] = True
            k >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least remaining capacity of at least ``length``, taken out."""
        some, k = self.some, self.leaves + length
        if not some[k]:
            while k > 1 and (k & 1 or not some[k + 1]):   # up to a right sibling that has some
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if some[2 * k] else 2 * k + 1
        remaining = k - self.leaves
        window = self.open[remaining].pop()
        if not self.open[remaining]:
            some[k] = False
            while k > 1:
                k >>= 1
                some[k] = some[2 * k] or some[2 * k + 1]
        return window, remaining


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; windows are numbered from 0."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, n = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = tree.take(length) if length < capacity else None
        if found is None:
            found, n = (n, capacity), n + 1
        window[i], offset[i] = found[0], capacity - found[1]
        if found[1] > length:
            tree.put(found[0], found[1] - length)
    return window, offset


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """``pieces`` (with length and the running number _n) with sequence_id and offset."""
    names = [c for c in pieces.columns if c != "_n"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_n")

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        first, held, n = TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal first
            rows = pa.Table.from_batches(held).combine_chunks()
            window, offset = best_fit_decreasing(rows.column("length").to_numpy(), capacity)
            out = rows.append_column("sequence_id", pa.array(first + window)).append_column("offset", pa.array(offset))
            first += int(window.max()) + 1
            return out.to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block).select(names)
                if n + part.num_rows > block:
                    yield from packed()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield from packed()

    dealt = pieces.repartition(F.xxhash64("_n", "ids_crc32"))
    return dealt.mapInArrow(pack, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, keep_ids: bool = False, block: int = BLOCK) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    return pack_pieces(token_pieces(docs, tokenizer, id_col, text_col, capacity, keep_ids), capacity, block)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of packed pieces that kept their ids: at most ``capacity`` ids a row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
