import gzip
import hashlib
import random
import tempfile

import pytest

from gradebook.llm import warc


def brute(rows, least):
    best = {}
    for p, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= least:
            best[raw] = max(best.get(raw, -1), -1 if p is None else p)
    out = []
    for p, _, html in rows:
        raw = (html or "").encode()
        first = raw not in best or best[raw] == (-1 if p is None else p)
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first else "revisit", None if first else best[raw]))
    return sorted(map(str, out))


def round_trip(spark, rows, chunk, least=20):
    folder = tempfile.mkdtemp(prefix="warc-") + "/a"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, folder, chunk_bytes=chunk, min_bytes=least)
    out = warc.resolve(warc.read_archives(spark, folder)).collect()
    return sorted(str((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type,
                       None if r.refers_to is None else int(r.refers_to))) for r in out), folder


BREAKS = ["", "\r", "\n", "\r\n", "\r\n\r\n", "a\r", "a\r\n", "a\r\n\r\n", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "x\r\r\n\r\r\n\n\r", "ü" * 40, "日本\r\n" * 30]


@pytest.mark.parametrize("chunk", [1, 3, 7, 64, 1 << 20])
def test_payloads_come_back_as_they_were(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, f"http://h/{i}\r\n", t) for i, t in enumerate(BREAKS)]
    rows += [(100 + i, None, "".join(rng.choice("ab\r\n é") for _ in range(rng.randint(0, 90)))) for i in range(40)]
    rows += [(200 + i, "u", "copy " * 20) for i in range(9)] + [(205, "u", "copy " * 20), (None, "u", "copy " * 20), (None, None, None), (7, None, "")]
    got, _ = round_trip(spark, rows, chunk)
    assert got == brute(rows, 20)


def test_only_null_ids(spark):
    rows = [(None, "u", "the same payload of some length")] * 3
    got, _ = round_trip(spark, rows, 8)
    assert got == brute(rows, 20)


def test_segments_carry_running_digests(spark):
    import glob
    payload = "0123456789" * 10
    _, folder = round_trip(spark, [(1, "u", payload)], 30, 1000)
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{folder}/*.gz"))
    assert raw.count(b"WARC-Type: continuation") == 3 and b"WARC-Segment-Total-Length: 100" in raw
    for n in (30, 60, 90, 100):
        assert b"WARC-Running-Digest: sha1:" + hashlib.sha1(payload[:n].encode()).hexdigest().encode() in raw


def test_a_cut_archive_is_an_error(spark, tmp_path):
    with gzip.open(tmp_path / "a.gz", "wb") as f:
        f.write(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 50\r\n\r\nHTTP/1.1 200 OK\r\n\r\nshort")
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_one_hot_page_and_responses_only(spark):
    """One payload on 10,000 pages beside others; and pages that are all different.  Reading back joins nothing."""
    from pyspark.sql import functions as F
    folder = tempfile.mkdtemp(prefix="warc-")
    hot = spark.range(10_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("hot page " * 200).alias("html"))
    own = spark.range(10_000, 10_300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page " * 300), "id").alias("html"))
    for name, pages, revisits in (("both", hot.union(own), 9999), ("own", own, 0)):
        warc.write_archives(pages.repartition(4), f"{folder}/{name}")
        out = warc.resolve(warc.read_archives(spark, f"{folder}/{name}"))
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        rows = out.collect()
        assert len(rows) == pages.count() and {r.refers_to for r in rows if r.record_type == "revisit"} == ({"9999"} if revisits else set())
        assert sum(r.record_type == "revisit" for r in rows) == revisits and all(r.payload_bytes >= 1500 and len(r.payload_digest) == 40 for r in rows)


def test_empty_and_clashing(spark):
    got, _ = round_trip(spark, [], 10)
    assert got == []
    pages = spark.createDataFrame([(1, "u", "x" * 30, 5, "r")], "page_id long, url string, html string, payload_bytes int, record_type string")
    folder = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write_archives(pages, folder)
    assert warc.resolve(warc.read_archives(spark, folder)).collect()[0].payload_bytes == 30
