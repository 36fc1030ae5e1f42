"""SentencePiece encoding and decoding by suffix-array matching.

The model file gives the pieces and their scores (byte-pair kind with byte fallback, a leading
blank, no normalisation).  Text is cut before every run of blanks, and before line feeds if the model joins
them to nothing: no piece reaches across, so these units are encoded on their own, each distinct one once.  For a batch of units:

1. index: the units are concatenated with separators and their suffixes sorted by the length of the
   longest piece (ranks of four characters, doubled until the length is reached);
2. match: every piece's range of suffixes is found by binary search, one character after another
   and for all pieces at once;
3. the ranges give the edges (start, length, piece) of a lattice, sorted by position;
4. relax: each unit starts as single characters and again and again takes the edge of the highest
   score, leftmost first, that joins two neighbours, for all units at once.  This is the merge order
   of the model's own encoder, so the ids are the same.

Characters without a piece become the ids of their UTF-8 bytes.  Encoding and decoding are maps over
the input; a task keeps up to ``CACHE`` units, and no text is shuffled.

Defined results: a null text has null ids and decodes to null, an empty one has none; decoding gives
back the text, except that U+2581, the model's sign for a blank, becomes a blank; unknown ids and
control ids decode to nothing; repeated rows repeat their result; other columns pass through.  A text without
blanks is one unit, so a task's memory grows with the longest such text; other texts of any length are cut at blanks.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

BLANK = "▁"
CACHE = 300_000
#: Longer units are relaxed one by one with a heap.
LONG_UNIT = 300
#: Characters of an index, and documents at a time.
CHARS = 1_000_000
SLICE = 1024
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message, the wire format of model files."""
    import struct

    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, i = raw[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = struct.unpack("<f" if n == 4 else "<d", raw[i:i + n])[0], i + n
        yield tag >> 3, value


class Pieces:
    """The pieces of a model file: field 1 of the file, each with text (1), score (2) and kind (3)."""

    NORMAL, CONTROL, BYTE = 1, 3, 6

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.text, self.score, self.kind = [], [], []
        for number, value in _fields(raw):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: self.NORMAL} | dict(_fields(value))
                self.text.append(piece[1].decode("utf-8"))
                self.score.append(piece[2])
                self.kind.append(piece[3])


class Encoder:
    """Encodes texts to ids; see the module's description."""

    def __init__(self, pieces: Pieces):
        normal = [i for i, k in enumerate(pieces.kind) if k == Pieces.NORMAL]
        self.score = np.array(pieces.score)
        self.single = {pieces.text[i]: i for i in normal if len(pieces.text[i]) == 1}
        self.byte = {int(pieces.text[i][3:5], 16): i for i, k in enumerate(pieces.kind) if k == Pieces.BYTE}
        long = sorted((i for i in normal if len(pieces.text[i]) > 1), key=lambda i: pieces.text[i])
        chars = sorted({c for i in long for c in pieces.text[i]})
        self.code = {c: n for n, c in enumerate(chars, 2)}             # 0: separator, 1: in no piece of two or more
        self.line_feed_alone = "\n" not in self.code                   # then no edge crosses one: a unit ends before it
        self.piece = np.array(long, np.int64)
        self.size = np.array([len(pieces.text[i]) for i in long], np.int64)
        self.longest = int(self.size.max(initial=1))
        self.chars = np.zeros((len(long), self.longest), np.int64)
        for row, i in enumerate(long):
            self.chars[row, :len(pieces.text[i])] = [self.code[c] for c in pieces.text[i]]
        points = np.array([ord(c) for c in chars], np.int64)
        self.points = np.zeros(0x110000, np.int32)
        self.points[:] = 1
        self.points[points] = np.arange(2, len(points) + 2)
        self.one = np.full(0x110000, -1, np.int32)                     # id of a character that is a piece
        self.one[[ord(c) for c in self.single]] = list(self.single.values())
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def suffixes(self, t: np.ndarray) -> np.ndarray:
        """Positions of ``t``, ordered by the ``longest`` characters from there on."""
        n, have = len(t), 4
        pad = np.concatenate([t.astype(np.int64), np.zeros(4, np.int64)])
        key = (pad[:n] << 48) | (pad[1:n + 1] << 32) | (pad[2:n + 2] << 16) | pad[3:n + 3]
        while True:
            order = np.argsort(key)
            if have >= self.longest:
                return order
            key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[1, key[1:] != key[:-1]])
            key = rank * (n + 1)
            key[:max(0, n - have)] += rank[have:]
            have *= 2

    def ranges(self, t: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every piece the range [low, high) of ``order`` whose suffixes begin with it."""
        low, high = np.zeros(len(self.piece), np.int64), np.full(len(self.piece), len(t), np.int64)
        pad = np.concatenate([t, np.zeros(self.longest, t.dtype)])
        alive = np.arange(len(self.piece))
        for d in range(self.longest):
            alive = alive[(self.size[alive] > d) & (low[alive] < high[alive])]
            if not len(alive):
                break
            want = self.chars[alive, d]
            bounds = []
            for value in (want, want + 1):                             # first place with at least this character
                a, b = low[alive].copy(), high[alive].copy()
                while (open_ := a < b).any():
                    mid = (a + b) >> 1
                    less = pad[order[np.minimum(mid, len(t) - 1)] + d] < value
                    a = np.where(open_ & less, mid + 1, a)
                    b = np.where(open_ & ~less, mid, b)
                bounds.append(a)
            low[alive], high[alive] = bounds
        short = low >= high
        high[short] = low[short]
        return low, high

    def edges(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys start * (longest + 1) + length of all occurrences of pieces, and the pieces."""
        order = self.suffixes(t)
        low, high = self.ranges(t, order)
        n = high - low
        row = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]]
        key = at * (self.longest + 1) + self.size[row]
        by = np.argsort(key)
        return key[by], self.piece[row[by]]

    def _scores(self, start: np.ndarray, end: np.ndarray, keys: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Score of the piece that covers start to end; -inf without one."""
        size = end - start
        key = start * (self.longest + 1) + size
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        hit = (size <= self.longest) & (keys[at] == key) if len(keys) else np.zeros(len(key), bool)
        return np.where(hit, self.score[piece[at]] if len(keys) else 0.0, -np.inf)

    def _relax_long(self, lo: int, hi: int, keys: np.ndarray, piece: np.ndarray) -> list[int]:
        """Symbol starts of one long unit."""
        a, b = np.searchsorted(keys, [lo * (self.longest + 1), hi * (self.longest + 1)])
        cover = dict(zip(keys[a:b].tolist(), self.score[piece[a:b]].tolist(), strict=True))
        after, before = {i: i + 1 for i in range(lo, hi)}, {i: i - 1 for i in range(lo, hi + 1)}
        heap: list = []

        def offer(i: int):
            if lo <= i and after[i] < hi:
                end = after[after[i]]
                if end - i <= self.longest and (s := cover.get(i * (self.longest + 1) + end - i)) is not None:
                    heapq.heappush(heap, (-s, i, after[i], end))

        for i in range(lo, hi):
            offer(i)
        while heap:
            _, i, mid, end = heapq.heappop(heap)
            if after.get(i) != mid or after.get(mid) != end:
                continue
            after[i], before[end] = end, i
            del after[mid]
            offer(i)
            if i > lo:
                offer(before[i])
        return sorted(after)

    def segment(self, units: list[str]) -> list[bytes]:
        """Ids of each unit, as 32-bit numbers."""
        text = "\0".join(units) + "\0"
        letters = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        t = self.points[letters]
        size = np.array([len(u) for u in units], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        t[begin + size] = 0
        keys, piece = self.edges(t)
        cut = np.zeros(len(t) + 1, bool)                               # where symbols start in the end
        short = size <= LONG_UNIT
        for u in np.flatnonzero(~short):
            cut[self._relax_long(int(begin[u]), int(begin[u] + size[u]), keys, piece)] = True
        n = size[short]
        unit = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[short][unit]
        end = start + 1
        score = self._pair_scores(unit, start, end, keys, piece, np.arange(len(unit)))
        while len(unit):
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.maximum.reduceat(score, first)
            per = np.cumsum(np.r_[False, unit[1:] != unit[:-1]])
            done = np.isneginf(best)
            if done.any():                                             # these units can take no more edges
                out = done[per]
                cut[start[out]] = True
                stay = ~out
                unit, start, end, score = unit[stay], start[stay], end[stay], score[stay]
                continue
            top = np.flatnonzero(score == best[per])
            top = top[np.r_[True, per[top[1:]] != per[top[:-1]]]]      # the leftmost of each unit
            end[top] = end[top + 1]
            stay = np.ones(len(unit), bool)
            stay[top + 1] = False
            moved = top - np.arange(len(top))                          # one symbol went before each later one
            unit, start, end, score = unit[stay], start[stay], end[stay], score[stay]
            touched = np.concatenate([moved, np.maximum(moved - 1, 0)])
            score[touched] = self._pair_scores(unit, start, end, keys, piece, touched)
        return self._ids(letters, begin, size, cut, keys, piece)

    def _pair_scores(self, unit, start, end, keys, piece, at) -> np.ndarray:
        """Scores of joining the symbols ``at`` with the next one of the same unit."""
        out = np.full(len(at), -np.inf)
        ok = at < len(unit) - 1
        ok[ok] = unit[at[ok]] == unit[at[ok] + 1]
        out[ok] = self._scores(start[at[ok]], end[at[ok] + 1], keys, piece)
        return out

    def _ids(self, letters: np.ndarray, begin, size, cut, keys, piece) -> list[bytes]:
        starts = np.flatnonzero(cut)
        a, b = np.searchsorted(starts, begin), np.searchsorted(starts, begin + size)
        ends = np.concatenate([starts[1:], [len(letters)]])
        ends[b[b > a] - 1] = (begin + size)[b > a]
        width = ends - starts
        ids = self.one[letters[starts]]
        if len(keys):
            long = width > 1
            ids[long] = piece[np.searchsorted(keys, starts[long] * (self.longest + 1) + width[long])]
        if (ids < 0).any():                                            # characters without a piece: their bytes
            n = np.ones(len(ids), np.int64)
            odd = {int(s): [self.byte[x] for x in chr(letters[starts[s]]).encode("utf-8", "replace")] for s in np.flatnonzero(ids < 0)}
            n[list(odd)] = [len(x) for x in odd.values()]
            to = np.cumsum(n) - n
            a, b = (np.r_[to, n.sum()][x] for x in (a, b))
            ids = np.repeat(ids, n)
            for s, x in odd.items():
                ids[to[s]:to[s] + len(x)] = x
        raw = ids.astype(np.int32).tobytes()
        return [raw[4 * lo:4 * hi] for lo, hi in zip(a.tolist(), b.tolist(), strict=True)]

    def units(self, text: str) -> list[str]:
        """The units of a text, without the blank that they begin with; those that begin with a line feed have none."""
        text = text.replace(BLANK, " ")
        if not text:
            return []
        found = (text.replace("\n", " \n") if self.line_feed_alone else text).split(" ")
        if "" in found:                                                # runs of blanks, or a blank at an end
            found = []
            for u in _UNITS.findall(BLANK + text.replace(" ", BLANK)):
                head, *rest = u[1:].split("\n") if self.line_feed_alone else [u[1:]]
                found.append(head)
                found.extend("\n" + x for x in rest)
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        units = [None if t is None else self.units(t) for t in texts]
        if len(self.known) > CACHE // 2:                               # units not met for two rounds are forgotten
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = set(chain.from_iterable(u for u in units if u)).difference(known)
        old = new.intersection(before)
        known.update((u, before[u]) for u in old)
        new = list(new - old)
        while new:                                                     # in parts of bounded size
            sizes = np.cumsum([len(u) + 2 for u in new])
            n = max(1, int(np.searchsorted(sizes, CHARS)))
            known.update(zip(new[:n], self.segment([u if self.line_feed_alone and u[:1] == "\n" else BLANK + u for u in new[:n]]), strict=True))
            new = new[n:]
        return [None if u is None else np.frombuffer(b"".join([known[x] for x in u]), np.int32) for u in units]


class Decoder:
    def __init__(self, pieces: Pieces):
        self.raw = [bytes([int(t[3:5], 16)]) if k == Pieces.BYTE else t.replace(BLANK, " ").encode() if k == Pieces.NORMAL else b""
                    for t, k in zip(pieces.text, pieces.kind, strict=True)]

    def decode_all(self, lists) -> list[str | None]:
        return [self.decode(ids.tolist() if isinstance(ids, np.ndarray) else ids) for ids in lists]

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        try:
            raw = b"".join(map(self.raw.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except (IndexError, TypeError):
            raw = None
        if raw is None:                                                # some id is null or unknown
            raw = b"".join([self.raw[i] for i in ids if i is not None and 0 <= i < len(self.raw)])
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def _added(df: DataFrame, source: str, steps: list[tuple]) -> DataFrame:
    """``df`` with a column for each (name, type, make) of ``steps``, in place of one of that name: the first
    ``make()`` converts slices of ``source``, each further one what the step before it gave."""
    from pyspark.sql import types as T

    df = df.drop(*[name for name, _, _ in steps])
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind, _ in steps]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = [(make(), pa.string() if isinstance(kind, T.StringType) else pa.list_(pa.int32())) for _, kind, make in steps]
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                values, out = part.column(source).to_pylist(), []
                for convert, to in made:
                    values = convert(values)
                    out.append(pa.array(values, to))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [*part.schema.names, *[name for name, _, _ in steps]])

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the piece ids of the whole text; ``model``: path of the model file on every node."""
    from pyspark.sql import types as T

    return _added(docs, text_col, [(ids_col, T.ArrayType(T.IntegerType()), lambda: Encoder(Pieces(model)).encode)])


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of the piece ids."""
    from pyspark.sql import types as T

    return _added(docs, ids_col, [(text_col, T.StringType(), lambda: Decoder(Pieces(model)).decode_all)])


def encode_and_decode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the piece ids and the text they decode to, in one pass."""
    from pyspark.sql import types as T

    return _added(docs, text_col, [(ids_col, T.ArrayType(T.IntegerType()), lambda: Encoder(Pieces(model)).encode),
                                   (decoded_col, T.StringType(), lambda: Decoder(Pieces(model)).decode_all)])
