"""Near-duplicate documents by MinHash with tensored banding, links confirmed on full sets.

A document's set is its distinct word shingles.  Two small collections of ``TABLES`` functions, each
of two minhashes, take 4 * ``TABLES`` minhashes in all; pairing a function of one with a function
of the other gives ``TABLES`` squared tables of four minhashes.  A pair at similarity s meets in no
table with probability about 2 * (1 - s*s) ** TABLES: 1e-4 at 0.75, 1e-5 at 0.8.

1. Equal sets are one class; only classes go on, so copies are never paired.
2. A table key is made only where both its halves are shared with another class.
3. Every class is paired with one other: of the smallest classes of its buckets, the one it meets most.
   Confirmed pairs give the first components.
4. In buckets that still hold several components, every class outside the largest one is held against
   all members of the others, in blocks of ``BLOCK`` classes.  192-bit sketches tell which classes have
   a foreign one that is not too far for the threshold (by five standard deviations); those are compared
   on their full sets within the blocks, which return only confirmed links.  So no link between
   components is lost and no pairs are made, however large a group is.  All tables take part; of buckets
   with the same classes (count and 128-bit fingerprint) one does, since the others would give the same links.

Confirmation compares the full shingle sets (64-bit hashes of the whole shingles), sent only for the
classes of some pair.  Components come from alternating star operations on the links.  Everything
that is read more than once is a table in the shared folder.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and is its own
component; component_id is the smallest id that is not null, null only where a component has no
other; of repeated rows exactly one is ``first``; an empty table gives no rows; other columns are kept out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradebook.llm.common import join_hot, stored

WORDS = 5
PERCENT = 75
TABLES = 12
#: Bits of 192 in which sketches at the threshold differ by more once in about a million pairs.
SKETCH_BITS = 62
#: A list of wanted texts up to this length is broadcast (40 bytes a row); a longer one is shuffled, and the texts with it.
BROADCAST_ROWS = 500_000
#: Classes on either side of a block of sketches, and shingles on either side of a block of full sets.
BLOCK = 4096
SET_BLOCK = 1 << 21
CACHE = 300_000
_MULT = np.random.default_rng(11).integers(1 << 62, size=WORDS + 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of ``x``."""
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(m)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, with a bounded cache of word hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.row, self.hash = words, {}, np.zeros(1024, np.uint64)

    def __call__(self, raw: bytes) -> np.ndarray:
        import xxhash

        found = raw.lower().split()            # on bytes: A-Z and ASCII white space only
        if not found:
            return np.zeros(0, np.uint64)
        row = self.row
        if len(row) > CACHE:
            row.clear()
        for w in set(found).difference(row):
            if len(row) == len(self.hash):
                self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.hash[len(row)] = xxhash.xxh64_intdigest(w)
            row[w] = len(row)
        x = self.hash[np.fromiter(map(row.__getitem__, found), np.int64, len(found))]
        k, n = self.words, len(x)
        if n < k:                               # the whole sequence, told apart from longer ones by its length
            s = sum(x[i:i + 1] * _MULT[i] for i in range(n)) + np.uint64(n)
        else:
            s = sum(x[i:n - k + 1 + i] * _MULT[i] for i in range(k))
        return np.unique(_mix(s))


def _family(tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(23)
    return (rng.integers(1 << 63, size=4 * tables, dtype=np.uint64) * np.uint64(2),
            rng.integers(1 << 62, size=4 * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def minhashes(shingles: np.ndarray, tables: int = TABLES) -> np.ndarray:
    flip, times = _family(tables)
    out = np.full(4 * tables, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 8192):
        np.minimum(out, ((shingles[i:i + 8192, None] ^ flip) * times).min(axis=0), out=out)
    return out


def half_keys(m: np.ndarray) -> np.ndarray:
    """Keys of the two-minhash functions: the first half belongs to one collection, the rest to the other."""
    at = np.arange(len(m) // 2, dtype=np.uint64)
    return _mix(m[0::2] * _MULT[0] + m[1::2] * _MULT[1] + at * _MULT[2]).view(np.int64)


def sketch(m: np.ndarray) -> np.ndarray:
    """Three words of 64 bits: four bits of each of 48 minhashes."""
    bits = (_mix(m[:48]) & np.uint64(15)).reshape(3, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, tables: int = TABLES) -> DataFrame:
    """Per row: _id, _text_key (hash of the text), _n (set size), _set (digest of the set), _half (half keys), _s0 to _s2."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingles = Shingler(words)
        for b in batches:
            n, sets, halves, sketches = [], [], [], []
            for text in b.column(1):
                s = shingles((text.as_py() or "").encode("utf-8", "replace"))
                m = minhashes(s, tables)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                halves.append(half_keys(m))
                sketches.append(sketch(m))
            flat = pa.array(np.concatenate(halves) if halves else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (2 * tables)), flat)
            s = np.array(sketches, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), lists, *(pa.array(s[:, i]) for i in range(3))],
                ["_id", "_text_key", "_n", "_set", "_half", "_s0", "_s1", "_s2"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_text_key")).mapInArrow(
        run, f"_id {kind}, _text_key long, _n long, _set binary, _half array<long>, _s0 long, _s1 long, _s2 long")


def table_rows(classes: DataFrame, tables: int = TABLES) -> DataFrame:
    """(cls, key) for every table key whose two halves the class shares with others."""
    halves = classes.select("cls", F.posexplode("_half").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    both = halves.join(shared, "half").groupBy("cls").agg(
        F.collect_list(F.when(F.col("at") < tables, F.struct("at", "half"))).alias("u"),
        F.collect_list(F.when(F.col("at") >= tables, F.struct("at", "half"))).alias("v"))   # at most TABLES each
    pair = lambda a, b: F.xxhash64(a["half"], b["half"])
    return both.select("cls", F.explode(F.flatten(F.transform("u", lambda a: F.transform("v", lambda b: pair(a, b))))).alias("key"))


def different_buckets(buckets: DataFrame) -> DataFrame:
    """The rows (cls, key) of the buckets of several classes, without buckets that hold the same classes as another."""
    mark = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"m{i}") for i in range(2)]
    sets = buckets.groupBy("key").agg(F.count("*").alias("n"), *mark).where("n > 1")
    return buckets.join(sets.groupBy("n", "m0", "m1").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").select("cls", "key")


def _dealt(buckets: DataFrame, roots: DataFrame, side: DataFrame, weight: str, block: int) -> DataFrame:
    """Rows of the buckets with several components, sorted by (key, block, deal): the members dealt over blocks
    (asks 0), and again those outside the largest component dealt over deals (asks 1); each block meets each deal.
    Blocks and deals hold about ``block`` of ``weight``, a column of ``side``."""
    known = side.select("cls", F.expr(weight).cast("long").alias("_w"))
    placed = buckets.join(known, "cls").join(roots, "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"), "_w")
    sizes = placed.groupBy("key", "root").agg(F.sum("_w").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda n: F.greatest(F.ceil(n / F.lit(block)), F.lit(1)).cast("long")
    mixed = mixed.select("key", F.col("x.root").alias("main"), parts(F.col("n")).alias("blocks"), parts(F.col("n") - F.col("x.n")).alias("deals"))
    members = placed.join(mixed, "key")
    hashed = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = members.where("root != main").select("key", each("blocks").alias("block"), hashed("deals").alias("deal"), F.lit(1).cast("long").alias("asks"), "cls", "root")
    asked = members.select("key", hashed("blocks").alias("block"), each("deals").alias("deal"), F.lit(0).cast("long").alias("asks"), "cls", "root")
    group = ["key", "block", "deal"]
    return asking.union(asked).join(side, "cls").select(*group, "asks", "cls", "root", *side.columns[1:]).repartition(*group).sortWithinPartitions(*group, "asks")


def _groups(batches: Iterator) -> Iterator:
    """(heads, further columns) of each group (key, block, deal), across Arrow batches; heads: the six long columns."""
    held: list = []
    for b in batches:
        x = np.stack([b.column(i).to_numpy() for i in range(6)], axis=1)
        more = [b.column(i) for i in range(6, b.num_columns)]
        cuts = [0, *(np.flatnonzero((x[1:, :3] != x[:-1, :3]).any(axis=1)) + 1), len(x)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                if held and (held[-1][0][0, :3] != x[lo, :3]).any():
                    yield _joined(held)
                    held = []
                held.append((x[lo:hi], [c.slice(lo, hi - lo) for c in more]))
    if held:
        yield _joined(held)


def _joined(held: list):
    import pyarrow as pa

    return np.concatenate([h[0] for h in held]), [pa.concat_arrays([h[1][i] for h in held]) for i in range(len(held[0][1]))]


def _with_near_foreign(batches: Iterator) -> Iterator:
    """(cls, key) of the classes that have, in this group, a class of another component near by sketch and size."""
    import pyarrow as pa

    for x, more in _groups(batches):
        n, *bits = (c.to_numpy() for c in more)
        bits = [b.view(np.uint64) for b in bits]           # bitwise_count takes the absolute value of signed numbers
        low, top = np.flatnonzero(x[:, 3] == 0), np.flatnonzero(x[:, 3] == 1)
        near = np.zeros(len(x), bool)
        for t in np.array_split(top, max(1, len(low) * len(top) >> 20)):
            far = sum(np.bitwise_count(s[t][:, None] ^ s[low]).astype(np.int16) for s in bits)
            ok = (x[t, 5][:, None] != x[low, 5]) & (far <= SKETCH_BITS) & (np.minimum(n[t][:, None], n[low]) * 100 >= np.maximum(n[t][:, None], n[low]) * PERCENT)
            near[t] |= ok.any(axis=1)
            near[low] |= ok.any(axis=0)
        found = np.unique(x[near][:, [4, 0]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["cls", "key"])


def _confirmed_links(batches: Iterator) -> Iterator:
    """Links (a, b) between components, confirmed on the full sets: per asking class one for each component."""
    import pyarrow as pa

    for x, (sets,) in _groups(batches):
        size = np.asarray(sets.value_lengths())
        word = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        begin = np.cumsum(size) - size
        low, top = np.flatnonzero(x[:, 3] == 0), np.flatnonzero(x[:, 3] == 1)
        rows = np.repeat(np.arange(len(low)), size[low])
        flat = np.concatenate([word[begin[i]:begin[i] + size[i]] for i in low]) if len(low) else word[:0]
        by = np.argsort(flat, kind="stable")
        rows, first = rows[by], np.searchsorted(flat[by], np.arange(len(word) + 1))   # the classes that hold each shingle
        out = []
        for t in top if len(low) else ():
            own = word[begin[t]:begin[t] + size[t]]
            both = np.bincount(np.concatenate([rows[first[w]:first[w + 1]] for w in own]), minlength=len(low))
            hit = low[(both * 100 >= (size[t] + size[low] - both) * PERCENT) & (x[low, 5] != x[t, 5])]
            hit = hit[np.unique(x[hit, 5], return_index=True)[1]]
            out.append(np.stack([np.maximum(x[hit, 4], x[t, 4]), np.minimum(x[hit, 4], x[t, 4])], axis=1))
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(cls, root) of every class in a link; root is the smallest class that it reaches.

    Alternates the large-star and small-star steps until the edges stay as they are; each step is a
    minimum per node, joined back, and written to the shared folder.
    """
    edges, before = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"), None
    while True:
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")).distinct()
        edges = stored(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("cls"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct().toDF("cls", "root"))
        before = now


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, _list) full shingle sets of the wanted classes (cls, _want, _text_key, _set), from their texts."""
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    rows = texts.join(F.broadcast(wanted) if few else wanted,
                      (F.col("_key") == F.col("_text_key")) & F.col("_id").eqNullSafe(F.col("_want"))).select("cls", "_set", "_text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        shingles = Shingler(words)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                cls, key, text = (b.column(k).slice(i, 128).to_pylist() for k in range(3))
                found = [shingles((t or "").encode("utf-8", "replace")) for t in text]
                keep = [j for j, s in enumerate(found) if xxhash.xxh3_128_digest(s.tobytes()) == key[j]]
                yield pa.RecordBatch.from_arrays([pa.array([cls[j] for j in keep], pa.int64()),
                                                  pa.array([found[j].view(np.int64) for j in keep], pa.list_(pa.int64()))], ["cls", "_list"])

    return rows.mapInArrow(run, "cls long, _list array<long>").dropDuplicates(["cls"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    both = (pairs.select("a", "b").join(sets.toDF("a", "_a"), "a").join(sets.toDF("b", "_b"), "b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * 100 >= (F.size("_a") + F.size("_b") - common) * PERCENT).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = WORDS, tables: int = TABLES) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (its id is the component's), first (one row of each component), text_key."""
    rows = stored(signatures(docs, id_col, text_col, words, tables).withColumn("_row", F.monotonically_increasing_id()), "signatures")
    full = rows.where("_n > 0")
    # min over (is null, id, row): the smallest id that is not null, one row of it.
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    rep = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), "_text_key", "_n", "_half", "_s0", "_s1", "_s2"))
    classes = full.groupBy("_set").agg(rep.alias("r"), F.count("*").alias("n")).select(
        "_set", "n", F.struct("r.none", "r.id", "r.row").alias("best"), F.col("r.row").alias("cls"), *[f"r.{c}" for c in ("_text_key", "_n", "_half", "_s0", "_s1", "_s2")])
    classes = stored(classes, "classes")
    side = classes.select("cls", "_n", "_s0", "_s1", "_s2")

    buckets = stored(table_rows(classes, tables), "buckets")
    stars = buckets.groupBy("key").agg(F.min("cls").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = buckets.join(stars, "key").where("cls != b").groupBy("cls", "b").agg(F.count("*").alias("n"))
    closest = met.groupBy("cls").agg(F.max(F.struct("n", (-F.col("b")).alias("less"))).alias("x")).select(F.col("cls").alias("a"), (-F.col("x.less")).alias("b"))
    closest = stored(closest, "closest")

    def sets_of(ids: DataFrame) -> DataFrame:
        want = classes.join(ids, "cls", "left_semi").select("cls", F.col("best.id").alias("_want"), "_text_key", "_set")
        return stored(_sets(docs, id_col, text_col, want, words), "sets")

    sets = sets_of(closest.select("a").union(closest.select("b")).toDF("cls").distinct())
    links = stored(_confirmed(closest, sets), "links")
    roots = components(links)
    near = stored(_dealt(stored(different_buckets(buckets), "different"), roots, side, "1", BLOCK).mapInArrow(_with_near_foreign, "cls long, key long").distinct(), "near")
    if not near.isEmpty():
        sets = sets_of(near.select("cls").distinct())
        more = _dealt(near, roots, sets, "size(_list)", SET_BLOCK).mapInArrow(_confirmed_links, "a long, b long").distinct()
        links = stored(links.union(more), "all-links")
        roots = components(links)

    # A component may hold any number of classes, and a class any number of rows: the names of large ones are broadcast.
    placed = stored(classes.join(roots, "cls", "left").select("_set", "best", "n", F.coalesce("root", "cls").alias("root")), "placed")
    lowest = stored(placed.groupBy("root").agg(F.min("best").alias("low"), F.count("*").alias("_classes")), "lowest")
    named = stored(join_hot(placed.select("_set", "n", "root"), lowest, "root", "_classes").select("_set", "n", "low"), "named")
    out = join_hot(full.select("_set", "_id", "_n", "_row", "_text_key"), named, "_set", "n").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("low.id").alias("component_id"), (F.col("low.row") == F.col("_row")).alias("first"),
        F.col("_text_key").alias("text_key"))
    alone = rows.where("_n = 0").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_id").alias("component_id"), F.lit(True).alias("first"), F.col("_text_key").alias("text_key"))
    out = out.union(alone)
    return out.select(id_col, "n_shingles", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"), "first", "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; rows of equal id and text count as one document."""
    stay = near_duplicates(docs, id_col, text_col).where("first").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__stay")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    kept = keyed.join(stay, (F.col("__key") == F.col("__stay")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates([id_col, "__key"]).select(*docs.columns)
