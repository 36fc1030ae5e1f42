"""Removal of passages that an earlier document holds, by longest-previous-factor arrays over suffix order.

A byte goes when a ``LENGTH``-byte string that covers it also starts in a document with a smaller id.  All strings are judged
on the input, so the first document with a passage keeps it and every later one loses it.

1. Every ``LENGTH``-byte window of a text has a key that depends on its bytes only: the least hash of its ``GRAM``-byte
   substrings.  A run of windows with one key makes a fragment (some 20 windows, 70 bytes), and equal windows, wherever they
   are, lie in fragments of one key.  Tasks send fragments to the bucket of their key, packed and compressed, one row per
   bucket and slice of ``SLICE`` bytes of text.  The number of buckets follows from the size of the corpus.
2. Within a slice and again within a bucket, equal fragments are one: the smallest document stays for it, and of
   the others the whole fragment goes at once.  A passage that a third of all documents share costs a row a slice.
3. A bucket, in parts of its keys, keeps the keys that several documents have.  The fragments of a key are joined, the starts whose window
   has a fingerprint in several documents are put into suffix order (by their first ``LENGTH`` bytes, a suffix array cut there),
   and for each suffix the previous and the next one of a smaller document are found.  No other suffix of a smaller document
   has a longer common prefix with it: the longer of the two is its longest previous factor, and one of ``LENGTH`` bytes
   or more covers its window.
4. The covered spans return to their documents and are cut out.

A bucket over ``BUCKET_LIMIT`` bytes (a key in very many different fragments) is dealt again, window by window, by a
hash of the whole window: equal windows meet again, and no rows are lost.  Long texts are read in slices that overlap by a window, so memory is
bounded by slices and buckets, and by the text that is rebuilt.

Defined results: a null text counts as empty; texts under ``LENGTH`` bytes lose nothing; rows of equal id never take from each other, and
rows of equal id and text get equal results; a null id comes after all others; matches never cross documents; an empty
table gives no rows; other columns are not read.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.common import stored

LENGTH = 50
GRAM = 12
SLICE = 8 << 20
BUCKET_BYTES = 32 << 20
BUCKET_LIMIT = 96 << 20
PART_BYTES = 4 << 20
STEP = 1 << 18
MAX_TASKS = 100_000
LAST = (1 << 63) - 1                          # the order of a null id
_MULT = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                  0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _MULT[0]
    x ^= x >> np.uint64(29)
    return x


def _hashes(text: bytes, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes (at least 8) from every position of ``text`` on."""
    word = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))      # the eight bytes from each position on
    n = len(text) - length + 1
    steps = [*range(0, length - 8, 8), length - 8]
    out = word[:n] * _MULT[0]
    for i, s in enumerate(steps[1:], 1):
        _mix(out)
        out += word[s:s + n] * _MULT[i % len(_MULT)]
    return _mix(out)


def _at(text: bytes, starts: np.ndarray, length: int) -> np.ndarray:
    """The hashes at ascending places, computed on pieces of ``text`` that stay in the cache."""
    out = np.empty(len(starts), np.uint64)
    for lo in range(0, len(text) - length + 1, STEP):
        a, b = np.searchsorted(starts, (lo, lo + STEP))
        if a < b:
            out[a:b] = _hashes(text[lo:lo + STEP + length - 1], length)[starts[a:b] - lo]
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` consecutive values, at every start."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[:len(x) - width + 1], out[width - done:]) if done < width else out


def fragments(text: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the fragments of texts that stand one after another up to ``ends``: maximal runs of windows of
    one key inside a text."""
    key = _least(_hashes(text, gram), length - gram + 1)                  # of the window at every start
    begins = np.concatenate([[0], ends[:-1]])
    cut = np.concatenate([[True], key[1:] != key[:-1], [True]])
    cut[np.minimum(np.concatenate([begins, np.maximum(ends - length + 1, begins)]), len(key))] = True
    edge = np.flatnonzero(cut)
    start, stop = edge[:-1], edge[1:]
    inside = start + length <= ends[np.searchsorted(begins, start, "right") - 1]
    return key[start[inside]], start[inside], stop[inside] + length - 1


#: A pack: numbers of fragments and of runs of one row; keys, places, lengths; length, document and row of each run; then the bytes.
_HEAD = (("key", "<u4"), ("at", "<i8"), ("size", "<i4"))
_RUNS = (("times", "<i4"), ("doc", "<i8"), ("row", "<i8"))


def _bytes(values: np.ndarray, kind: str) -> bytes:
    """All first bytes, then all second ones, and so on: the high bytes are mostly equal and pack well."""
    return np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(raw: bytes, at: int, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind).ravel()


def _packed(cols: dict, pieces: list) -> bytes:
    """Fragments in the order of their texts."""
    import pyarrow as pa

    new = np.flatnonzero(np.concatenate([[True], (cols["doc"][1:] != cols["doc"][:-1]) | (cols["row"][1:] != cols["row"][:-1])]))
    runs = {"times": np.diff(np.append(new, len(pieces))), "doc": cols["doc"][new], "row": cols["row"][new]}
    raw = b"".join([len(pieces).to_bytes(8, "little"), len(new).to_bytes(8, "little"), *[_bytes(cols[c], t) for c, t in _HEAD],
                    *[_bytes(runs[c], t) for c, t in _RUNS], *pieces])
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _size(pack: bytes) -> int:
    return int.from_bytes(pack[:8], "little")


def _unpacked(pack: bytes) -> tuple[dict, bytes, np.ndarray]:
    """Columns, bytes, and where in them each fragment starts."""
    import pyarrow as pa

    raw = pa.decompress(memoryview(pack)[8:], decompressed_size=_size(pack), codec="zstd", asbytes=True)
    n, m = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    at, cols = 16, {}
    for fields, k in ((_HEAD, n), (_RUNS, m)):
        for c, t in fields:
            cols[c] = _values(raw, at, k, t)
            at += cols[c].nbytes
    times = cols.pop("times")
    cols |= {c: np.repeat(cols[c], times) for c in ("doc", "row")}
    return cols, raw, at + np.cumsum(cols["size"], dtype=np.int64) - cols["size"]


def folded(pieces: list, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[dict, list]:
    """Per different fragment its smallest document with all its places there, and the spans of the other documents."""
    seen: dict[bytes, list] = {}
    gone: list[tuple] = []
    for piece, *where in zip(pieces, doc.tolist(), row.tolist(), at.tolist(), strict=True):
        old = seen.setdefault(piece, [])
        if not old or where[0] == old[0][0]:
            old.append(where)
        elif where[0] > old[0][0]:
            gone.append((*where, where[2] + len(piece)))
        else:
            gone += [(*o, o[2] + len(piece)) for o in old]
            seen[piece] = [where]
    return seen, gone


def previous_smaller(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one in its segment with a smaller value, or -1: all pointers jump at once."""
    p = np.arange(len(values)) - 1
    p[:1] = -1
    p[1:][segment[1:] != segment[:-1]] = -1
    while True:
        far = np.flatnonzero(p >= 0)
        far = far[values[p[far]] >= values[far]]
        if not len(far):
            return p
        p[far] = p[p[far]]


def earlier_copies(text: bytes, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes of ``text`` at ``starts`` share at least ``length`` bytes with one of a smaller document.

    In suffix order, the longest previous factor of a suffix is its common prefix with the nearest suffix of a smaller document
    before or after it.  Order and prefixes are cut at ``length``, so a factor that long is one in the same run of equal prefixes.
    """
    if not len(starts):
        return np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)
    head = np.ascontiguousarray(view[starts]).view(f"S{length}").ravel()        # all of one length: trailing zeros do not matter
    order = np.argsort(head, kind="stable")
    sorted_, values = head[order], docs[order]
    run = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
    before = previous_smaller(values, run)
    after = previous_smaller(values[::-1], run[::-1])[::-1]
    found = np.zeros(len(starts), bool)
    found[order] = (before >= 0) | (after >= 0)
    return found


def _several(groups: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which rows belong to a group (equal values of ``groups``) of several documents."""
    if not len(groups):
        return np.zeros(0, bool)
    order = np.argsort(groups, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], groups[order][1:] != groups[order][:-1]]))
    both = np.minimum.reduceat(docs[order], first) != np.maximum.reduceat(docs[order], first)
    out = np.empty(len(groups), bool)
    out[order] = np.repeat(both, np.diff(np.append(first, len(groups))))
    return out


def covered(cols: dict, pieces: list, length: int) -> list[tuple]:
    """Spans (doc, row, start, end) that go, of the fragments of one bucket."""
    seen, gone = folded(pieces, cols["doc"], cols["row"], cols["at"])
    text, places = b"".join(seen), list(seen.values())
    if len(text) < length:
        return gone
    size = np.fromiter(map(len, seen), np.int64, len(seen))
    begin = np.cumsum(size) - size
    windows = size - length + 1
    piece = np.repeat(np.arange(len(size)), windows)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[piece]
    doc = np.array([p[0][0] for p in places], np.int64)[piece]
    mark = _at(text, start, length)
    maybe = _several(mark, doc)
    piece, start, doc, mark = piece[maybe], start[maybe], doc[maybe], mark[maybe]
    hit = np.zeros(len(start), bool)
    sets = len(start) // STEP + 1                 # equal windows have one fingerprint: each set of fingerprints has an order of its own
    for k in range(sets):
        some = np.flatnonzero(mark % np.uint64(sets) == k)
        hit[some] = earlier_copies(text, start[some], doc[some], length)
    piece, at = piece[hit], (start - begin[piece])[hit]
    if len(piece):
        new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] > at[:-1] + length)]))
        for i, lo, hi in zip(piece[new].tolist(), at[new].tolist(), at[np.append(new[1:], len(at)) - 1].tolist(), strict=True):
            gone += [(d, r, a + lo, a + hi + length) for d, r, a in places[i]]
    return gone


_PACK = "bucket long, pack binary, doc long, row long, start long, end long"


def _batch(packs: list[tuple], spans: list[tuple]):
    """Packs (bucket, pack) and spans (doc, row, start, end) as one batch: a row is either."""
    import pyarrow as pa

    left = [pa.array([p[i] for p in packs] + [None] * len(spans), t) for i, t in enumerate((pa.int64(), pa.binary()))]
    right = [pa.array([None] * len(packs) + [s[i] for s in spans], pa.int64()) for i in range(4)]
    return pa.RecordBatch.from_arrays(left + right, [c.split()[0] for c in _PACK.split(", ")])


def _by_bucket(cols: dict, text: bytes, begin: np.ndarray, bucket: np.ndarray) -> Iterator[tuple]:
    """Fold the fragments that share a key, and pack all that is left by bucket; yields (packs, spans)."""
    order = np.argsort(bucket, kind="stable")                   # in a bucket, the order of the texts
    cols, begin, bucket = {c: v[order] for c, v in cols.items()}, begin[order], bucket[order]
    pieces = [text[a:b] for a, b in zip(begin.tolist(), (begin + cols["size"]).tolist(), strict=True)]
    stay, spans = np.ones(len(pieces), bool), []
    again = np.flatnonzero(_several(cols["key"], cols["doc"]))
    if len(again):
        seen, spans = folded([pieces[i] for i in again], *(cols[c][again] for c in ("doc", "row", "at")))
        lost = {(d, r, s) for d, r, s, _ in spans}
        for i in again.tolist():
            stay[i] = (int(cols["doc"][i]), int(cols["row"][i]), int(cols["at"][i])) not in lost
    left = np.flatnonzero(stay)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[left][1:] != bucket[left][:-1]])), len(left)) if len(left) else []
    packs = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        at = left[lo:hi]
        some = [pieces[i] for i in at]
        packs.append((int(bucket[at[0]]), _packed({c: v[at] for c, v in cols.items()}, some)))
    return packs, spans


def _cut(buckets: int, length: int, gram: int):
    """Texts (doc, row, text) to packs of fragments, slice by slice."""
    def run(batches: Iterator) -> Iterator:
        held: list[tuple] = []                      # (doc, row, first byte, bytes)
        size = 0

        def sent():
            raw = b"".join(h[3] for h in held)
            ends = np.cumsum([len(h[3]) for h in held])
            found, step = [], STEP
            lo = 0
            while lo < len(held):                   # some texts at a time: arrays that stay in the cache
                base = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + step, "right")))
                key, start, end = fragments(raw[base:int(ends[hi - 1])], ends[lo:hi] - base, length, gram)
                found.append((key, start + base, end + base))
                lo = hi
            key, start, end = (np.concatenate([f[i] for f in found]) for i in range(3))
            of = np.searchsorted(ends, start, "right")
            begins = np.concatenate([[0], ends[:-1]])
            doc, row, at = (np.array([h[i] for h in held], np.int64)[of] for i in range(3))
            cols = {"key": (key >> np.uint64(32)).astype(np.uint32), "doc": doc, "row": row, "at": at + start - begins[of], "size": end - start}
            return _batch(*_by_bucket(cols, raw, start, (key % np.uint64(buckets)).astype(np.int64)))

        for b in batches:
            for doc, row, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                for at in range(0, max(1, len(raw) - length + 1), SLICE):       # a slice: the windows that start in it
                    part = raw[at:at + SLICE + length - 1]
                    if len(part) >= length:
                        held.append((doc.as_py(), row.as_py(), at, part))
                        size += len(part)
                    if size >= SLICE:
                        yield sent()
                        held, size = [], 0
        if held:
            yield sent()

    return run


def _windows(buckets: int, pack: bytes, length: int) -> tuple[list, list]:
    """A pack of a hot bucket dealt again, one fragment a window, keyed by a hash of the whole window."""
    cols, raw, begin = _unpacked(pack)
    n = cols["size"] - length + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[of] + step
    key = _at(raw, start, length)
    new = {"key": (key >> np.uint64(32)).astype(np.uint32), "doc": cols["doc"][of], "row": cols["row"][of], "at": cols["at"][of] + step, "size": np.full(len(of), length)}
    return _by_bucket(new, raw, start, (key % np.uint64(buckets)).astype(np.int64))


def _part(packs: list[bytes], part: int, parts: int, length: int) -> list[tuple]:
    """The spans of the fragments of a bucket whose key falls to ``part`` of ``parts``."""
    cols: dict = {}
    pieces: list = []
    for pack in packs:
        own, raw, begin = _unpacked(pack)
        mine = np.flatnonzero(own["key"] % parts == part)
        for c, v in own.items():
            cols.setdefault(c, []).append(v[mine])
        pieces += [raw[a:b] for a, b in zip(begin[mine].tolist(), (begin[mine] + own["size"][mine]).tolist(), strict=True)]
    cols = {c: np.concatenate(v) for c, v in cols.items()}
    several = np.flatnonzero(_several(cols["key"], cols["doc"]))
    return covered({c: v[several] for c, v in cols.items()}, [pieces[i] for i in several.tolist()], length)


def _judged(buckets: int, length: int, limit: int | None):
    """Packs sorted by bucket, and spans, to spans.  A bucket keeps its packs as they came and is judged by parts of its keys; one of
    more than ``limit`` bytes is hot, and its packs are dealt again."""
    def run(batches: Iterator) -> Iterator:
        bucket, held, size, hot = None, [], 0, False

        def spans():
            parts = -(-size // PART_BYTES) if held else 0
            for part in range(parts):
                yield _batch([], _part(held, part, parts, length))

        for b in batches:
            done = b.filter(b.column(0).is_null())
            if done.num_rows:
                yield done
            for key, pack in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key is None:
                    continue
                if key != bucket:
                    yield from spans()
                    bucket, held, size, hot = key, [], 0, False
                held.append(pack)
                size += _size(pack)
                hot = hot or limit is not None and size > limit
                if hot:
                    for h in held:
                        yield _batch(*_windows(buckets, h, length))
                    held = []
        yield from spans()

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
                   bucket_bytes: int = BUCKET_BYTES, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(doc, row, start, end): byte spans that go, not merged; doc is the id (null: ``LAST``), row the hash of the text."""
    if not 8 <= gram <= length - 1:
        raise ValueError("substrings of 8 bytes at least, shorter than the window")
    texts = _texts(docs, id_col, text_col).where(F.octet_length("text") >= length)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(1, -(-4 * total // bucket_bytes))              # fragments overlap: some four times the text
    sent, limit = texts.mapInArrow(_cut(buckets, length, gram), _PACK), bucket_limit
    tasks = min(buckets, MAX_TASKS)
    found = None
    while sent is not None:
        # Packs meet by bucket, and the buckets are dealt evenly over the tasks; spans ride along, spread by their document.
        task = F.pmod(F.coalesce("bucket", F.xxhash64("doc", "row")), F.lit(tasks)).cast("int")
        dealt = sent.withColumn("task", task).repartitionById(tasks, "task").drop("task").sortWithinPartitions("bucket")
        judged = stored(dealt.mapInArrow(_judged(buckets, length, limit), _PACK), "spans")
        spans = judged.where("bucket is null").select("doc", "row", "start", "end")
        found = spans if found is None else found.union(spans)
        again = judged.where("bucket is not null")
        sent, limit = (again, None) if limit is not None and not again.isEmpty() else (None, None)
    return found


def _without(batches: Iterator) -> Iterator:
    """Texts and their spans to the merged spans and the bytes left."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part, merged, kept = b.slice(lo, 256), [], []
            texts, spans = part.column(1), part.column(2)
            for i in range(part.num_rows):
                raw, own = (texts[i].as_py() or "").encode("utf-8", "replace"), []
                if spans[i].is_valid:
                    s = spans[i].values
                    start, end = s.field(0).to_numpy(), s.field(1).to_numpy()
                    order = np.argsort(start, kind="stable")
                    start, reach = start[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
                    own = list(zip(start[new].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist(), strict=True))
                merged.append([{"start": s, "end": e} for s, e in own])
                cuts = [0, *(x for s in own for x in s), len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(merged, kind), pa.array(kept, pa.binary())], ["id", "spans", "kept"])


def drop_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """Per row: its id, the removed spans (array of start and end, in bytes, in order and apart) and the bytes kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = repeated_spans(docs, id_col, text_col, length, **options).groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one document
    texts = _texts(docs, id_col, text_col).withColumn("id", F.when(F.col("doc") != LAST, F.col("doc")).cast(kind))
    long = F.octet_length("text") >= length
    rows = texts.where(long).join(found, ["doc", "row"], "left").select("id", "text", "spans")
    rows = rows.mapInArrow(_without, f"id {kind}, spans array<struct<start: bigint, end: bigint>>, kept binary")
    short = texts.where(~F.coalesce(long, F.lit(False))).select("id", F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"),
                                                               F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"))
    return rows.union(short).withColumnRenamed("id", id_col)
