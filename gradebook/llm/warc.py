"""WARC archives written and read by Spark, payloads as chunk rows.

Writing: every payload becomes rows (record, chunk number, chunk) of at most ``chunk_bytes``.  A
task walks its rows in order and carries the SHA-1 state from chunk to chunk, so Python never
holds a whole payload; the digest of the whole is known at the last chunk.  A first walk gives lengths and
digests, from which revisits are decided; a second one renders the records.  A payload of several
chunks is written as WARC segments: a first record and ``continuation`` records, the last of which
states the total length.  Spark's text writer stores one record per row, with the record end as
line separator, in gzip files, so archives can lie in any store Spark can write.

Reading: Spark's text reader streams the lines of each file in order to one task (gzip files are
not split), and a state machine follows the content lengths across rows and Arrow batches.

Of records with equal payloads of at least ``min_bytes``, the one with the largest id is a
``response`` and the others are ``revisit`` records without a body that refer to it and state its page id and length.

Defined results: a null payload is an empty one; a null id is smaller than any other and a
payload that only null ids have is a response each time; rows of equal id and payload are records of
equal id and kind; an empty table gives an empty archive;
payload bytes are kept as they are, line ends included; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm.common import join_hot, stored

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The revisit profile of the WARC standard for equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_BYTES = 1 << 20
MIN_BYTES = 1000


def _record_id(page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
                                          for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)])


def chunk_rows(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table: ``pages`` with a binary ``_payload`` (null: no body) becomes one row per record and chunk number, in order
    within a task.  A chunk is cut when its row is made, so no row holds a payload and its chunks."""
    rest = [c for c in pages.columns if c != "_payload"]
    n = F.greatest(F.coalesce(F.ceil(F.octet_length("_payload") / chunk_bytes), F.lit(1)), F.lit(1)).cast("int")
    rows = pages.select(*rest, "_payload", n.alias("n_chunks")).select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    return rows.select(*rest, "n_chunks", "chunk_no", F.substring("_payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))


def _digests(batches: Iterator) -> Iterator:
    """Chunk rows (_id, _key, n_chunks, chunk_no, chunk) to lengths and digests of the records: the state is carried from chunk to chunk."""
    import pyarrow as pa

    state, size = None, 0
    for b in batches:
        at, sizes, found = [], [], []
        for i, (n, no, chunk) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), strict=True)):
            if no == 0:
                state, size = hashlib.sha1(), 0
            raw = chunk.as_buffer()
            state.update(raw)
            size += raw.size
            if no == n - 1:
                at.append(i)
                sizes.append(size)
                found.append(state.hexdigest())
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(sizes, pa.int64()), pa.array(found, pa.string())],
                                         ["_id", "_key", "payload_bytes", "payload_digest"])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per page: _id, _url, record_id, record_type, refers_to, refers_to_record (of revisits), _payload (null for revisits),
    payload_bytes, payload_digest (of the full payload).

    Lengths and digests come from the chunk rows.  Who revisits whom is decided on the narrow table of ids and digests; only
    the decision joins the payloads, by page, so copies of one payload never gather."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.encode(text, "UTF-8").alias("_payload"), F.xxhash64(text).alias("_key"))
    kind = base.schema["_id"].dataType.simpleString()
    chunks = chunk_rows(base.select("_id", "_key", "_payload"), chunk_bytes)
    facts = chunks.mapInArrow(_digests, f"_id {kind}, _key long, payload_bytes long, payload_digest string").distinct()
    facts = stored(facts.withColumn("_same", F.concat_ws(":", "payload_digest", "payload_bytes")), "warc-facts")
    best = facts.where(F.col("payload_bytes") >= min_bytes).groupBy("_same").agg(F.max("_id").alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    best = stored(best, "warc-best")
    single = facts.join(best.select(F.col("_same").alias("_of")), F.col("_same") == F.col("_of"), "left_anti").withColumn("_best", F.col("_id"))
    told = single.drop("_same").unionByName(join_hot(facts, best, "_same", "_n").drop("_same"))
    told = told.withColumnsRenamed({"_id": "_tid", "_key": "_tkey"})
    out = base.join(told, (F.col("_key") == F.col("_tkey")) & F.col("_id").eqNullSafe(F.col("_tid")))
    revisit = ~F.col("_best").eqNullSafe(F.col("_id"))
    return out.select(
        "_id", "_url", _record_id(F.col("_id"), F.col("payload_digest")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_best")).alias("refers_to"),
        F.when(revisit, _record_id(F.col("_best"), F.col("payload_digest"))).alias("refers_to_record"),
        F.when(~revisit, F.col("_payload")).alias("_payload"), "payload_bytes", "payload_digest")


def _lines(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in fields if v is not None)).encode() + CRLF.encode()


def _clean(url: str | None) -> str | None:
    """A field value stays on one line."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _render(batches: Iterator) -> Iterator:
    """Chunk rows to record bytes; the SHA-1 state is carried from a record's chunk to its next."""
    import pyarrow as pa

    state = None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            no, n, chunk = r["chunk_no"], r["n_chunks"], r["chunk"] or b""
            state = hashlib.sha1() if no == 0 else state
            state.update(chunk)
            if no == n - 1 and r["record_type"] == "response" and state.hexdigest() != r["payload_digest"]:
                raise ValueError(f"{r['record_id']}: the chunks differ from the payload")
            head = b""
            if no == 0 and r["record_type"] == "response":
                head = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                        f"Content-Length: {r['payload_bytes']}{CRLF}{CRLF}").encode()
            first = f"<{r['record_id']}>"
            fields = [("WARC-Type", r["record_type"] if no == 0 else "continuation"),
                      ("WARC-Record-ID", first if no == 0 else f"<{r['record_id']}#{no + 1}>"),
                      ("WARC-Date", DATE),
                      ("WARC-Target-URI", _clean(r["_url"])),
                      ("Page-Id", None if r["_id"] is None else str(r["_id"])),
                      ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                      ("WARC-Running-Digest", f"sha1:{state.hexdigest()}" if n > 1 else None),
                      ("WARC-Segment-Number", str(no + 1) if n > 1 else None),
                      ("WARC-Segment-Origin-ID", first if no else None),
                      ("WARC-Segment-Total-Length", str(r["payload_bytes"]) if n > 1 and no == n - 1 else None),
                      ("WARC-Profile", PROFILE if r["record_type"] == "revisit" else None),
                      ("WARC-Refers-To", f"<{r['refers_to_record']}>" if r["refers_to_record"] else None),
                      ("Refers-To-Page-Id", None if r["refers_to"] is None else str(r["refers_to"])),
                      ("Payload-Length", str(r["payload_bytes"]) if r["record_type"] == "revisit" else None),
                      ("Content-Type", "application/http; msgtype=response" if no == 0 else None),
                      ("Content-Length", str(len(head) + len(chunk)))]
            out.append(_lines(fields) + head + chunk)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES) -> None:
    """Write one WARC record per page (more for payloads over ``chunk_bytes``) under ``folder``."""
    rows = chunk_rows(records(pages, id_col, url_col, payload_col, min_bytes, chunk_bytes), chunk_bytes)
    # One file per task: all segments of a record come from one task, in order.
    (rows.mapInArrow(_render, "value binary").select(F.col("value").cast("string"))
     .write.option("compression", "gzip").option("lineSep", CRLF * 2).text(folder))


SCHEMA = ("record_id string, record_type string, page_id string, refers_to string, refers_to_record string, "
          "payload_bytes long, payload_digest string, stated_digest string, stated_bytes long")


def _parse(batches: Iterator) -> Iterator:
    """Lines in file order to records.  ``left``: bytes of the block still to come; ``open_``: the
    record whose payload is being read, kept across its segments."""
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if " long" in x else pa.string() for x in SCHEMA.split(", ")]
    fields: dict[str, str] = {}
    file, left, http, open_, n, sha = None, 0, False, None, 0, None
    mode = "between"

    def ended():
        done = dict(open_, payload_bytes=n, payload_digest=sha.hexdigest())
        if done["record_type"] == "revisit":
            done |= {"payload_bytes": None, "payload_digest": None}
        elif done["stated_digest"] != done["payload_digest"]:
            raise ValueError(f"{done['record_id']}: the payload differs from its digest")
        return done

    for batch in batches:
        out = []
        for line, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if path != file:
                if mode != "between" or open_:
                    raise ValueError(f"{file} ends within a record")
                file = path
            if mode == "block":
                if http:                         # the HTTP head belongs to the block, not to the payload
                    left -= len(line) + 2
                    http = bool(line)
                    if left > 0 or http:
                        continue
                    line, left = b"", 0
                elif left > len(line):           # the separator was part of the payload
                    line += b"\r\n"
                line = line[:left] if left < len(line) else line
                sha.update(line)
                n += len(line)
                left -= len(line)
                if left:
                    continue
                mode = "between"
                if not open_.pop("more"):
                    out.append(ended())
                    open_ = None
                continue
            if mode == "between":
                if line.startswith(b"WARC/"):
                    mode, fields = "head", {}
                continue
            if line:
                k, _, v = line.decode("utf-8", "replace").partition(": ")
                fields[k.lower()] = v
                continue
            mode, left = "block", int(fields["content-length"])
            segment, kind = int(fields.get("warc-segment-number", 0)), fields["warc-type"]
            more = segment > 0 and "warc-segment-total-length" not in fields
            if kind == "continuation":
                if not open_ or f"<{open_['record_id']}>" != fields["warc-segment-origin-id"]:
                    raise ValueError(f"{file}: a segment without its first record")
                open_["more"] = more
            else:
                open_ = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind,
                         "page_id": fields.get("page-id"), "refers_to": fields.get("refers-to-page-id"),
                         "stated_bytes": int(fields["payload-length"]) if "payload-length" in fields else None, "refers_to_record": fields.get("warc-refers-to", "").strip("<>") or None,
                         "stated_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "more": more}
                n, sha = 0, hashlib.sha1()
                http = kind == "response" and left > 0
            if not left:
                mode = "between"
                if not open_.pop("more"):
                    out.append(ended())
                    open_ = None
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for c, k in zip(names, kinds, strict=True)], names)
    if mode != "between" or open_:
        raise ValueError(f"{file} ends within a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives under ``folder``; digests and lengths are those of the payload as
    read (null for revisits, which have no body)."""
    lines = spark.read.option("lineSep", CRLF).text(folder)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("path")).mapInArrow(_parse, SCHEMA)


def resolve(recs: DataFrame) -> DataFrame:
    """Records with their payload facts: those of the payload as read, or for a revisit those that its own fields state
    about the response it refers to.  No join."""
    return recs.select("page_id", F.coalesce("payload_bytes", "stated_bytes").alias("payload_bytes"),
                       F.coalesce("payload_digest", "stated_digest").alias("payload_digest"), "record_type", "refers_to")
