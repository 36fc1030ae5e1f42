"""Vector codes of equal parts, with codebooks refined over Hilbert-sorted flat blocks.

Components become integers, and every vector is cut into ``parts`` equal parts.  Each part position has a
codebook of ``entries`` integer vectors, first the parts of the rows of the smallest ids, then refined
``rounds`` times: every part goes to its nearest entry (squared distance, ties to the lower index), and an
entry that is used becomes the componentwise floor of the mean of its parts.

1. For each part position the parts are sorted along a Hilbert curve, by range partitioning in Spark on
   (position, curve key, row), and cut into flat blocks of at most ``BLOCK`` consecutive parts.  A block is
   one stored row: rows, components, the corners of its box, and the sum of its parts.
2. In each round, the least and the greatest distance from a box to every entry give the block's shortlist:
   entries whose least distance is not above the smallest greatest one.  No other entry can be nearest
   to any part of the block.
3. A shortlist of one entry takes the whole block by its stored sum; a longer one is evaluated by a small kernel
   in exact integers.
4. Tasks return one partial sum per position and entry that they met.  Only the codebooks, bounded by the
   parameters, reach the driver.

Blocks are cut by count, so equal parts, however many, are spread over many blocks.  The curve is laid out
on a bounded sample (about ``SAMPLE`` rows); it has no influence on any result.

Defined results: vectors that are null or hold null or non-finite components, or have another than the most frequent
length, are dropped; a length that ``parts`` does not divide is an error, as is a component whose floor is beyond
``common.COMPONENT``; rows of equal id are rows of their own, and of those the smaller vector comes
first in the codebook; a null id comes last; with fewer rows than ``entries`` the codebooks are that short; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.ann_curves import Curves
from gradebook.llm.common import floored, join_hot, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 256
SAMPLE = 4096

_BLOCKS = "part int, n int, rows binary, x binary, low binary, high binary, total binary"


def _points(layout: list[Curves], parts: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().reshape(b.num_rows, parts, -1)
            for p in range(parts):
                key = layout[p].keys(x[:, p].astype(np.float64))[0]
                flat = np.ascontiguousarray(x[:, p], dtype="<i4")
                step = flat.shape[1] * 4
                raw = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer((np.arange(len(flat) + 1) * step).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), p, np.int32)), pa.array(key), b.column(0), raw], ["part", "key", "row", "x"])

    return run


def _cut(size: int):
    """Sorted points to blocks of at most BLOCK consecutive points of one position."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, rows, points = None, [], []

        def block():
            x = np.frombuffer(b"".join(points), "<i4").reshape(len(rows), size)
            return [part, len(rows), np.array(rows, "<i8").tobytes(), x.tobytes(), x.min(axis=0).tobytes(), x.max(axis=0).tobytes(),
                    x.sum(axis=0, dtype=np.int64).tobytes()]

        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        for b in batches:
            out = []
            for p, r, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if rows and (p != part or len(rows) == BLOCK):
                    out.append(block())
                    rows, points = [], []
                part = p
                rows.append(r)
                points.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block(), kinds, strict=True)], names)

    return run


def flat_blocks(rows: DataFrame, parts: int, size: int) -> DataFrame:
    """Stored blocks of (row, vec) rows: the parts of each position in the order of its Hilbert curve."""
    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(n // SAMPLE + 1)) == 0).select("vec").toPandas()["vec"].tolist()   # about SAMPLE rows
    sample = np.array(some or [rows.first()["vec"]], np.float64).reshape(-1, parts, size)
    layout = [Curves(sample[:, p], curves=1) for p in range(parts)]
    points = rows.select("row", "vec").mapInArrow(_points(layout, parts), "part int, key long, row long, x binary")
    spread = points.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part", "key", "row")
    return stored(spread.sortWithinPartitions("part", "key", "row").mapInArrow(_cut(size), _BLOCKS), "blocks")


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries (e, d) may be nearest to a point of each box (b, d) to (b, d): a (b, e) mask."""
    under, over = low[:, None] - book, book - high[:, None]
    least = (np.maximum(np.maximum(under, over), 0) ** 2).sum(axis=2)
    most = (np.maximum(-under, -over) ** 2).sum(axis=2)
    return least <= most.min(axis=1, keepdims=True)


def _assigned(batches: Iterator, books: np.ndarray) -> Iterator:
    """(position, n, rows, x, total, codes) of each block; codes is an int where the shortlist has one entry."""
    size = books.shape[2]
    for b in batches:
        part, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        raw = [b.column(i).to_pylist() for i in range(2, 7)]
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            low, high, total = (np.stack([np.frombuffer(raw[i][k], t) for k in at]).astype(np.int64) for i, t in ((2, "<i4"), (3, "<i4"), (4, "<i8")))
            for k, mask, s in zip(at, shortlists(low, high, books[p]), total, strict=True):
                few = np.flatnonzero(mask)
                x = np.frombuffer(raw[1][k], "<i4").reshape(-1, size).astype(np.int64)
                if len(few) == 1:
                    yield p, n[k], raw[0][k], x, s, int(few[0])
                else:
                    near = ((x[:, None] - books[p][few]) ** 2).sum(axis=2)
                    yield p, n[k], raw[0][k], x, s, few[near.argmin(axis=1)]


def _sums(books: np.ndarray):
    """Per position and entry: how many parts it takes, and their sums by component (-1: the count)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parts, entries, size = books.shape
        sums = np.zeros((parts, entries, size + 1), np.int64)
        for p, n, _, x, total, code in _assigned(batches, books):
            if isinstance(code, int):
                sums[p, code, :size] += total
                sums[p, code, size] += n
            else:
                for e in np.unique(code):
                    mine = x[code == e]
                    sums[p, e, :size] += mine.sum(axis=0)
                    sums[p, e, size] += len(mine)
        p, e = np.nonzero(sums[:, :, size])
        at = np.repeat(np.arange(len(p)), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(p[at].astype(np.int32)), pa.array(e[at].astype(np.int32)),
                                          pa.array(np.tile(np.arange(size + 1, dtype=np.int32), len(p))), pa.array(sums[p, e].ravel())], ["part", "entry", "at", "total"])

    return run


def refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; the sums are exact."""
    found = blocks.mapInArrow(_sums(books), "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()          # bounded: parts * entries * (size + 1)
    total = {(r.part, r.entry, r.at): int(r.total) for r in found}
    size, new = books.shape[2], books.copy()
    for p, e in {k[:2] for k in total}:
        new[p, e] = [total[p, e, i] // total[p, e, size] for i in range(size)]
    return new


def _codes(books: np.ndarray):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for p, n, rows, x, _, code in _assigned(batches, books):
            code = np.full(n, code) if isinstance(code, int) else code
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows, "<i8")), pa.array(np.full(n, p, np.int32)), pa.array(code.astype(np.int64)),
                                              pa.array(((x - books[p][code]) ** 2).sum(axis=1))], ["row", "part", "code", "error"])

    return run


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Per row: its id, code (two hex digits a part), error (squared distance to its entries), label_error (sum over
    the rows of its label) and codebooks_sha256."""
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits tell 1 to 256 entries apart")
    rows = floored(table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("_x")), "_x").drop("_x")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "floors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    kind = rows.schema["id"].dataType.simpleString()
    if not first:
        return table.sparkSession.createDataFrame([], f"{id_col} {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if not first[0].vec or len(first[0].vec) % parts:
        raise ValueError(f"vectors of {len(first[0].vec)} components have no {parts} equal parts")
    size = len(first[0].vec) // parts
    books = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, size).transpose(1, 0, 2).copy()

    blocks = flat_blocks(rows, parts, size)
    for _ in range(rounds):
        books = refined(blocks, books)

    # Eight codes make a word: a row's words are the bitwise or of its parts.
    words = -(-parts // 8)
    codes = blocks.mapInArrow(_codes(books), "row long, part int, code long, error long")
    word = lambda w: F.bit_or(F.when(F.floor(F.col("part") / 8) == w, F.call_function("shiftleft", F.col("code"), (8 * (7 - F.col("part") % 8)).cast("int"))).otherwise(0))
    codes = codes.groupBy("row").agg(F.sum("error").alias("error"), *[word(w).alias(f"w{w}") for w in range(words)])
    text = F.concat(*[F.lower(F.lpad(F.hex(f"w{w}"), 16, "0")) for w in range(words)])
    coded = stored(rows.select("id", "label", "row").join(codes.select("row", "error", F.substring(text, 1, 2 * parts).alias("code")), "row"), "codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    out = join_hot(coded.select("id", "label", "code", "error"), stored(labels, "label-errors"), "label", "n")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
