"""Distribution cuts (R1) and sequence cuts (R2) as window / array expressions."""

from __future__ import annotations

import uuid
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Non-whitespace runs, with whitespace spelled out so Java and RE2 agree.
TOKEN_PATTERN = r"[^\t\n\x{0b}\f\r ]+"


#: A group's rows that a task holds before it leaves their decision to the second pass.
HELD = 1 << 20


def _exact(values, starts: list[int]) -> tuple[list[int], list[int]]:
    """Finite doubles as integer multiples of 2**e, and the e of each group, given by its first row."""
    import numpy as np

    m, e = np.frexp(values)
    whole, e = np.ldexp(m, 53).astype(np.int64).tolist(), e - 53
    low = np.minimum.reduceat(e, starts)
    shifts = e - np.repeat(low, np.diff([*starts, len(e)]))
    return [w << s for w, s in zip(whole, shifts.tolist(), strict=True)], low.tolist()


def _stretches(cuts: list[int], held: int):
    """The runs between ``cuts`` as (start, end, starts of whole runs): smaller ones than ``held`` that lie between others
    together, every other run alone and without starts."""
    inner: list[int] = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo and hi < cuts[-1] and hi - lo < held:
            inner.append(lo)
            continue
        if inner:
            yield inner[0], lo, inner
            inner = []
        yield lo, hi, []


def _fraction(whole: int, e: int) -> Fraction:
    return Fraction(whole << e) if e >= 0 else Fraction(whole, 1 << -e)


def _text(f: Fraction) -> str:
    return f"{f.numerator}/{f.denominator}"


def _share(value: Fraction, total: Fraction) -> float | None:
    """Rounded once; a total of zero has no shares."""
    if not total:
        return None
    f = value / total
    return f.numerator / f.denominator


def _first_pass(part: Fraction, group: int, value: int, held: int):
    """Rows sorted by (group, order) to rows with shares, where the whole group was seen, or with what is ahead of them in their
    chunk (``_ahead``), and on a chunk's last row what the chunk adds up to (``_sum``)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        pid, chunk, first = TaskContext.get().partitionId(), 0, True
        parts: list = []                               # slices of the open group
        rows, open_, deferred = 0, None, False

        def told(table, shares, kept, ahead, sums):
            n = table.num_rows
            columns = [*table.columns, pa.array(shares, pa.float64()), pa.array(kept, pa.float64()), pa.array(ahead, pa.string()), pa.array(sums, pa.string()),
                       pa.array([pid] * n, pa.int32()), pa.array([chunk] * n, pa.int64())]
            names = [*table.schema.names, "share", "kept_share", "_ahead", "_sum", "_pid", "_chunk"]
            yield from pa.Table.from_arrays(columns, names).combine_chunks().to_batches()

        def later():
            nonlocal parts, rows, chunk, deferred
            table = pa.Table.from_batches(parts)
            whole, [e] = _exact(table.column(value).to_numpy(), [0])
            ahead = accumulate(whole, initial=0)
            n = len(whole)
            out = [_text(_fraction(a, e)) for a in ahead]
            yield from told(table, [None] * n, [None] * n, out[:-1], [None] * (n - 1) + out[-1:])
            parts, rows, chunk, deferred = [], 0, chunk + 1, True

        def decided(table, starts):
            """One table for all its groups: a group alone would be a batch of a few rows."""
            whole, _ = _exact(table.column(value).to_numpy(), starts)
            numerator, denominator = part.as_integer_ratio()
            at, shares, kept = [], [], []
            for lo, hi in zip(starts, [*starts[1:], len(whole)], strict=True):
                own = whole[lo:hi]
                total, reach, stay = sum(own), 0, []
                bound = total * numerator
                for i, w in enumerate(own):
                    if reach * denominator <= bound:
                        stay.append(i)
                    reach += w
                some = [own[i] for i in stay]
                left = sum(some)
                at += [lo + i for i in stay]
                shares += [w / total if total else None for w in some]
                kept += [w / left if left else None for w in some]
            none = [None] * len(at)
            yield from told(table if len(at) == len(whole) else table.take(pa.array(at, pa.int64())), shares, kept, none, none)

        def ended(last: bool):
            nonlocal parts, rows
            if parts and (first or deferred or last):
                yield from later()
            elif parts:
                table, parts, rows = pa.Table.from_batches(parts), [], 0
                yield from decided(table, [0])

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group)
            new = pc.or_(pc.fill_null(pc.not_equal(g[1:], g[:-1]), False), pc.not_equal(pc.is_null(g[1:]), pc.is_null(g[:-1])))
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), b.num_rows]
            for lo, hi, inner in _stretches(cuts, held):
                now = g[lo].as_py()
                if (parts or deferred) and now != open_:
                    yield from ended(False)
                    first, deferred = False, False
                if inner:
                    yield from decided(pa.Table.from_batches([b.slice(lo, hi - lo)]), [i - lo for i in inner])
                    continue
                open_ = now
                parts.append(b.slice(lo, hi - lo))
                rows += hi - lo
                if rows >= held:
                    yield from later()
        yield from ended(True)

    return run


def _second_pass(part: Fraction, of: dict, value: int, names: list[str]):
    """Deferred rows, given (what is ahead of the chunk, the total of the group[, the kept total]) of every chunk: without
    kept totals the sums of what is kept by chunk, else the kept rows with their shares."""
    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            keys = list(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True))
            values = [Fraction(v) for v in b.column(value).to_pylist()]
            ahead = [Fraction(a) + of[k][0] for a, k in zip(b.column(len(names)).to_pylist(), keys, strict=True)]
            stay = [i for i, (a, k) in enumerate(zip(ahead, keys, strict=True)) if a <= part * of[k][1]]
            if len(next(iter(of.values()))) == 2:
                for i in stay:
                    sums[keys[i]] = sums.get(keys[i], 0) + values[i]
                continue
            kept = b.take(pa.array(stay, pa.int64()))
            shares = [[_share(values[i], of[keys[i]][j]) for i in stay] for j in (1, 2)]
            yield pa.RecordBatch.from_arrays([*kept.columns[:len(names)], *(pa.array(x, pa.float64()) for x in shares)], [*names, "share", "kept_share"])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int64()),
                                              pa.array([_text(x) for x in sums.values()])], ["_pid", "_chunk", "_sum"])

    return run


def cumulative_share_cut(df: DataFrame, group: str, value: str, p: float, tiebreak: list[str], held: int = HELD) -> DataFrame:
    """Per group keep the largest shares until ``p`` is covered (a row is kept
    when the running total *before* it is at most ``p``), then renormalise.

    Order is value desc then ``tiebreak``.  Sums and comparisons are exact for any finite doubles, so the kept rows do not depend on
    the order or the partitions in which values are added; shares are rounded once.  ``p`` is the decimal number it is
    written as.  Values that are null, NaN or infinite take no part; where a total is zero, shares are null.

    One way for groups of any size: the rows are range-partitioned on (group, order) and sorted.  A task decides the groups that
    it sees whole; the first and last group of its partition, and what exceeds ``held`` rows of one group, become chunks
    that carry exact running sums.  The sums of the chunks (two a partition, and one for every ``held`` rows) are added on the driver, and a second
    pass decides the deferred rows.  No group is gathered.
    """
    from gradebook.session import materialize

    part = Fraction(str(p))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(group), F.desc("_v"), *[F.col(c) for c in tiebreak]]
    v = F.col(value).cast("double")
    rows = df.withColumn("_v", v).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    names, at = rows.columns, len(rows.columns) - 1
    extra = ["share double", "kept_share double", "_ahead string", "_sum string", "_pid int", "_chunk long"]
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(", ".join(extra)).fields])
    seen = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first_pass(part, names.index(group), at, held), schema)
    seen = materialize(seen, f"share-cut-{uuid.uuid4().hex}")

    ends = seen.where("_sum is not null").select("_pid", "_chunk", F.col(group).alias("_group"), "_sum").orderBy("_pid", "_chunk").collect()
    groups: list[list] = []                            # runs of chunks of one group
    for r in ends:
        if not groups or groups[-1][0]["_group"] != r["_group"]:
            groups.append([])
        groups[-1].append(r)
    of: dict = {}
    for chunks in groups:
        sums = [Fraction(r["_sum"]) for r in chunks]
        for r, ahead in zip(chunks, accumulate(sums, initial=Fraction(0)), strict=False):
            of[r["_pid"], r["_chunk"]] = (ahead, sum(sums))
    done = seen.where("_ahead is null").select(*df.columns, "share", "kept_share")
    if not of:
        return done
    rest = seen.where("_ahead is not null").select(*names, "_ahead", "_pid", "_chunk")
    kept = dict.fromkeys(of, Fraction(0))
    for r in rest.mapInArrow(_second_pass(part, of, at, names), "_pid int, _chunk long, _sum string").collect():     # a row a task and chunk
        kept[r["_pid"], r["_chunk"]] += Fraction(r["_sum"])
    for chunks in groups:
        keys = [(r["_pid"], r["_chunk"]) for r in chunks]
        total = sum(kept[k] for k in keys)
        for k in keys:
            of[k] = (*of[k], total)
    out = StructType([*rows.schema.fields, *StructType.fromDDL("share double, kept_share double").fields])
    return done.union(rest.mapInArrow(_second_pass(part, of, at, names), out).select(*df.columns, "share", "kept_share"))


def tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(TOKEN_PATTERN), 0)


def sequence_cut(df: DataFrame, text: str, end_marker: str, max_len: int) -> DataFrame:
    """R2: cut each token sequence before its first end marker and to ``max_len``.

    The whole text is tokenised; the cut position is reported with the counts.
    """
    t = df.withColumn("_tok", tokens(text))
    pos = F.array_position("_tok", F.lit(end_marker))
    n = F.size("_tok")
    kept = F.least(F.when(pos > 0, pos - 1).otherwise(n), F.lit(max_len))
    return t.select(
        "*", n.cast("long").alias("n_tokens"),
        F.when(pos > 0, pos).otherwise(F.lit(None)).cast("long").alias("end_pos"),
        kept.cast("long").alias("kept_tokens"),
        F.array_join(F.slice("_tok", 1, kept), " ").alias("kept_text"),
    ).drop("_tok")
