import zlib

import pytest

from gradebook.llm import sharding


def brute(docs, n):
    rows = sorted((d.doc_id is not None, d.doc_id or 0, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    total, before, out, slots = sum(r[2] for r in rows), 0, [], {}
    for some, id_, size, crc in rows:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((id_ if some else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("partitions", [3, 11])
def test_equals_prefix_sums(spark, odd_docs, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for docs, n in ((odd_docs, 4), (odd_docs, 40), (spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 40)):
            got = sharding.byte_shards(docs, n).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
            assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(docs.collect(), n)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sizes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.byte_shards(docs, 40).collect()
    per = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(40)]
    assert max(per) - min(per) <= 2 * max(r["size"] for r in rows)


def test_empty_and_clashing(no_docs, clashing_docs):
    assert sharding.byte_shards(no_docs, 40).count() == 0
    assert sharding.byte_shards(clashing_docs, 3).count() == clashing_docs.count()
