"""Line deduplication across documents by a deletion-neighbourhood join.

Lines are compared as lower-cased word sequences.  A line goes when an earlier line (by document id, then line number) is equal to
it, or, from ``MIN_WORDS`` words on, differs by one word: inserted, left out or replaced.  (One word of a shorter line is
too much of it to call it the same.)  The earliest line of a set stays.  Lines without words stay.

1. Equal lines are one class, kept at its earliest position (a minimum per 128-bit digest).
2. Of two lines one edit apart, the first or the last half of the shorter one stands unchanged in the
   longer one, so a line that shares neither of its half keys has no neighbour and makes no variants.
3. Every other line emits its deletion neighbourhood as hashed keys: itself and itself without each word.
   Lines that meet in a variant with the same word left out differ by a replacement; a line that
   meets another's variant lacks one word of it.
4. A variant's earliest line is its one partner: a minimum per key, joined back.  No pairs within a
   group are made, so a passage that thousands of lines share costs as many rows.
5. The edit distance of every candidate and its partner is verified on the words.

Nothing but keys and positions is shuffled before step 3; texts move for lines with a shared half
and once more to rebuild the documents.

Defined results: null texts stay null; rows of equal id and text are one document and get equal
results; a null id comes before all others; an empty table gives no rows; line ends other than a
line feed belong to the line; texts of any length are taken whole; other columns pass through, except that ``_line_count``,
``_removed_lines`` and ``_copied_bytes`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.common import stored

MIN_WORDS = 8
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of the halves for partners of the same or greater length, then of one word less."""
    from xxhash import xxh3_64_intdigest as digest

    out, n = [], len(words)
    for m in (n, n - 1):
        h = m // 2
        out += [digest(b" ".join(words[:h]), 2 * m), digest(b" ".join(words[n - (m - h):]), 2 * m + 1)]
    return out


def variants(words: list[bytes]) -> np.ndarray:
    """Hash of the whole sequence, then of the sequence without each word."""
    from xxhash import xxh3_64_intdigest as digest

    x = np.array([digest(w) for w in words], np.uint64) * np.cumprod(np.full(len(words), _STEP))
    before = np.concatenate([[np.uint64(0)], np.cumsum(x)])
    z = np.concatenate([before[-1:], before[:-1] + (before[-1] - before[1:]) * _BACK])
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


def within_one(a: list, b: list) -> bool:
    """Whether one inserted, left out or replaced word, or none, turns ``a`` into ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    if len(a) == len(b):
        return a[i + 1:] == b[i + 1:]
    return a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def _line_keys(kind: str, min_words: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            at, no, rows, short, size = [], [], [], [], []
            for i, text in enumerate(b.column(2)):
                for k, line in enumerate(_lines(text.as_py())):
                    words = line.split()
                    if words:
                        whole = b" ".join(words)
                        at.append(i)
                        no.append(k)
                        short.append(len(words) < min_words)
                        size.append(len(whole) - len(words) + 1)
                        rows.append([digest(whole), digest(whole, 1), *([0] * 4 if short[-1] else half_keys(words))])
            keys = np.array(rows, np.uint64).reshape(-1, 6).view(np.int64).T
            keys = [*map(pa.array, keys[:2]), *(pa.array(k, mask=np.array(short, bool)) for k in keys[2:])]   # short lines have no halves
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(no, pa.int32()), pa.array(size, pa.int32()), *keys],
                                             ["id", "text_key", "no", "size", "h1", "h2", "k0", "k1", "k2", "k3"])

    return run, f"id {kind}, text_key long, no int, size int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long"


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split(b"\n")


def _chosen_lines(batches: Iterator) -> Iterator:
    """(pos, words) of the chosen line numbers of each text."""
    import pandas as pd

    for b in batches:
        ids, keys, nos, out = [], [], [], []
        for id_, key, text, chosen in zip(b["id"], b["text_key"], b["_text"], b["chosen"], strict=True):
            lines = _lines(text)
            for k in chosen:
                ids.append(id_)
                keys.append(key)
                nos.append(k)
                out.append(b" ".join(lines[k].split()))
        yield pd.DataFrame({"id": pd.Series(ids, dtype=b["id"].dtype if ids else None), "text_key": keys, "no": nos, "line": out})


def _emit(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        for start in range(0, b.num_rows, 512):
            part = b.slice(start, 512)
            z = [variants(bytes(x).split()) for x in part.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(z)), [len(x) for x in z]))
            gone = np.concatenate([np.arange(-1, len(x) - 1) for x in z]) if z else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(gone.astype(np.int32)),
                                              pa.array(np.concatenate(z) if z else np.zeros(0, np.int64))], ["pos", "gone", "z"])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_key, removed, copied): the numbers, from 0, of the lines of each document that go, and how many of their bytes
    (white space aside) have their earliest copies in one and the same other document, at most."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    lines = stored(texts.mapInArrow(*_line_keys(kind, min_words)), "lines")
    pos = F.struct("id", "text_key", "no")
    classes = lines.groupBy("h1", "h2").agg(F.min(pos).alias("pos"), *[F.first(f"k{i}").alias(f"k{i}") for i in range(4)])
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "line-classes")

    halves = classes.where("k0 is not null").select("cls", F.explode(F.array("k0", "k1", "k2", "k3")).alias("k"))
    shared = halves.select("k").groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    maybe = classes.select("cls", "pos").join(halves.join(shared, "k").select("cls").distinct(), "cls").select("pos.*")
    chosen = maybe.groupBy("id", "text_key").agg(F.collect_list("no").alias("chosen"))   # at most a document's lines
    # Rows of equal id and text give one line only.
    words = texts.join(chosen.withColumnsRenamed({"id": "_id", "text_key": "_key"}), (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    words = words.select("id", "text_key", "_text", "chosen").mapInPandas(_chosen_lines, f"id {kind}, text_key long, no int, line binary")
    words = stored(words.select(pos.alias("pos"), "line").dropDuplicates(["pos"]), "line-words")

    neighbours = words.select("pos", "line").mapInArrow(_emit, f"pos struct<id: {kind}, text_key: long, no: int>, gone int, z long")
    whole = F.col("gone") < 0
    met = neighbours.groupBy("z").agg(F.min(F.when(whole, F.col("pos"))).alias("as_whole"), F.min(F.when(~whole, F.col("pos"))).alias("as_variant"),
                                      F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(neighbours.join(met, "z"), "line-variants")
    indel = met.select("pos", F.when(whole, F.col("as_variant")).otherwise(F.col("as_whole")).alias("partner"))
    same = met.where(~whole).groupBy("z", "gone").agg(F.min("pos").alias("partner"), F.count("*").alias("n")).where("n > 1")
    swap = met.where(~whole).join(same, ["z", "gone"]).select("pos", "partner")
    pairs = indel.union(swap).where("partner < pos").distinct()

    @F.pandas_udf("boolean")
    def verified(a, b):
        import pandas as pd
        return pd.Series([within_one(bytes(x).split(), bytes(y).split()) for x, y in zip(a, b, strict=True)], dtype=bool)

    near = (pairs.join(words.toDF("pos", "a"), "pos").join(words.toDF("partner", "b"), "partner")
            .where(verified("a", "b")).groupBy("pos").agg(F.min("partner").alias("near")))
    first = classes.join(near, "pos", "left").select("h1", "h2", "pos", "near")
    gone = lines.join(first, ["h1", "h2"]).where(F.col("near").isNotNull() | (F.col("pos") < pos))
    gone = gone.select("id", "text_key", "no", "size", F.when(F.col("pos") < pos, F.col("pos.id")).otherwise(F.col("near.id")).alias("of"))
    # One exchange for both sums: by document and source, then by document.
    by = gone.repartition("id", "text_key").groupBy("id", "text_key", "of").agg(F.collect_set("no").alias("nos"), F.sum("size").alias("size"))
    other = F.when(~F.col("of").eqNullSafe(F.col("id")), F.col("size"))
    return by.groupBy("id", "text_key").agg(F.flatten(F.collect_list("nos")).alias("removed"),       # at most a document's lines
                                            F.coalesce(F.max(other), F.lit(0)).alias("copied"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated lines, and with _line_count, _removed_lines and _copied_bytes (of the text as it came; the last
    as ``copied`` of ``repeated_lines``)."""
    removed = repeated_lines(docs, id_col, text_col, min_words).toDF("_rid_", "_rkey_", "_gone_", "_copied_")
    inner = F.struct(*docs.columns).alias("_doc_")                    # so that no column of the input clashes with these
    out = docs.select(inner, F.xxhash64(text_col).alias("_tkey_")).join(
        removed, (F.col("_tkey_") == F.col("_rkey_")) & F.col(f"_doc_.`{id_col}`").eqNullSafe(F.col("_rid_")), "left")
    lines = F.split(F.col(f"_doc_.`{text_col}`"), "\n", -1)
    out = out.select("_doc_", "_gone_", "_copied_", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("_n_"), F.when(F.col("_gone_").isNotNull(), lines).alias("_all_"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_all_) - 1), _gone_), i -> _all_[i]), '\n')")
    text = F.when(F.col("_gone_").isNotNull(), kept).otherwise(F.col(f"_doc_.`{text_col}`"))
    rest = [c for c in docs.columns if c not in ("_line_count", "_removed_lines", "_copied_bytes")]
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_doc_.`{c}`").alias(c) for c in rest],
                      F.col("_n_").alias("_line_count"), F.coalesce(F.size("_gone_"), F.lit(0)).cast("long").alias("_removed_lines"),
                      F.coalesce("_copied_", F.lit(0)).cast("long").alias("_copied_bytes"))
