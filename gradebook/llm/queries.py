"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to the whole of its table.  ``ORACLE`` has DuckDB SQL where SQL can
express the result; the other queries are tested against brute force in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm import (ann_curves, hard_negatives, language_id, line_dedup, minhash_dedup, packing, piece_tokens, quality_rules, sharding,
                           suffix_dedup, toxicity, vector_codes, warc)
from gradebook.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return put


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    """All documents encoded to pieces and decoded again; checksums of the ids and of both texts."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = piece_tokens.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    crc = lambda c: F.crc32(F.encode(c, "UTF-8"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
                      crc("text").alias("text_crc32"), crc("decoded").alias("decoded_crc32"),
                      F.translate("text", piece_tokens.BLANK, " ").eqNullSafe(F.col("decoded")).alias("round_trip"))


_LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, regexp_extract_all(
        translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
      FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT words, min({'d': doc_id, 'i': i}) AS pos FROM l WHERE len(words) > 0 GROUP BY words),
m AS (SELECT * FROM c WHERE len(words) >= 8),
v AS (SELECT pos, g, len(words) AS n, array_to_string(list_concat(words[:g - 1], words[g + 1:]), ' ') AS z
      FROM (SELECT pos, words, unnest(range(1, len(words) + 1)) AS g FROM m)),
w AS (SELECT pos, array_to_string(words, ' ') AS z FROM m),
swap AS (SELECT pos, min(pos) OVER (PARTITION BY z, g, n) AS partner FROM v),
near AS (SELECT pos FROM swap WHERE partner < pos
         UNION SELECT v.pos FROM v JOIN w ON v.z = w.z WHERE w.pos < v.pos
         UNION SELECT w.pos FROM v JOIN w ON v.z = w.z WHERE v.pos < w.pos),
k AS (SELECT l.doc_id, l.i, l.line, c.pos IS NOT NULL AND
             (c.pos < {'d': l.doc_id, 'i': l.i} OR c.pos IN (SELECT pos FROM near)) AS gone
      FROM l LEFT JOIN c ON c.words = l.words),
t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed_lines,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM k GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
       md5(t.text) AS text_md5, length(t.text)::BIGINT AS n_chars
FROM documents LEFT JOIN t USING (doc_id)
"""


@query("op2_line_dedup", _LINES_SQL)
def op2_line_dedup(spark, sf_dir):
    """All documents without lines that repeat an earlier line or, from 8 words on, differ from one by one word."""
    out = line_dedup.dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_line_count").alias("n_lines"), F.col("_removed_lines").alias("n_removed_lines"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
                      F.length("text").cast("long").alias("n_chars"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    """Language of every whole text; documents whose id falls into remainder 1 of 3 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    net = language_id.train(docs.where(~held))
    return language_id.predict(docs.select("doc_id", held.alias("held_out"), "text"), net).drop("text")


@query("op5_byte_shards")
def op5_byte_shards(spark, sf_dir):
    """All documents in 40 contiguous shards of nearly equal bytes."""
    out = sharding.byte_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    """Toxicity score of every whole text; labels whose id falls into remainder 2 of 4 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scorer = toxicity.fit(docs, labels.where(~held))
    out = toxicity.score(docs.select("doc_id", "text"), scorer).drop("text")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


_STOPS = ", ".join("'" + w + "'" for w in quality_rules.stop_words())


def _rule_sql() -> str:
    parts = []
    for measure, times, of, low, high in quality_rules.RULES:
        total = of or "1"
        parts += [f"{measure} * {times} >= {total} * {low}"] if low is not None else []
        parts += [f"{measure} * {times} <= {total} * {high}"] if high is not None else []
    return " AND ".join(parts)


_QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM s)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM w) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM
        (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words,
        len(list_filter(words, lambda x: lower(x) <> upper(x)))::BIGINT AS n_letter_words,
        len(list_filter(words, lambda x: x = upper(x) AND lower(x) <> x AND length(x) > 1))::BIGINT AS n_upper_words,
        len(list_filter(lines, lambda x: substr(ltrim(x), 1, 1) IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
        len(list_filter(lines, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))::BIGINT AS n_ellipsis_lines
      FROM s LEFT JOIN rep USING (rid)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {_rule_sql()}) AS kept FROM b
"""


@query("op7_quality_rules", _QUALITY_SQL)
def op7_quality_rules(spark, sf_dir):
    """Counts, ratios and verdict of the threshold table for every document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT rid, page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM f),
k AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM best AS revisit FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN best END AS refers_to FROM k
"""


@query("op10_warc", _WARC_SQL)
def op10_warc(spark, sf_dir):
    """All pages written as WARC records to the shared folder and read back."""
    folder = shared_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    out = warc.resolve(warc.read_archives(spark, folder))
    return out.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("long").alias("refers_to"))


@query("op8_ann_curves")
def op8_ann_curves(spark, sf_dir):
    """The 5 nearest embeddings of every vec_id divisible by 50."""
    return ann_curves.neighbours(table(spark, sf_dir, "embeddings"))


_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
c AS (SELECT min(rid) AS cls, min(doc_id) AS low, words FROM w WHERE len(words) > 0 GROUP BY words),
g AS (SELECT DISTINCT cls, array_to_string(words[i:i + 4], ' ') AS sh FROM
        (SELECT cls, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM c)),
n AS (SELECT cls, count(*) AS n FROM g GROUP BY cls),
common AS (SELECT x.cls AS a, y.cls AS b, count(*) AS k FROM g x JOIN g y ON x.sh = y.sh AND x.cls <> y.cls GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n na ON na.cls = a JOIN n nb ON nb.cls = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT cls, cls AS at FROM c UNION SELECT reach.cls, e.b FROM reach JOIN e ON e.a = reach.at),
root AS (SELECT reach.cls, min(c.low) AS component_id FROM reach JOIN c ON c.cls = reach.at GROUP BY reach.cls)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       CASE WHEN len(w.words) > 0 THEN root.component_id ELSE w.doc_id END AS component_id,
       w.doc_id IS NOT DISTINCT FROM CASE WHEN len(w.words) > 0 THEN root.component_id ELSE w.doc_id END AS kept
FROM w LEFT JOIN c ON c.words = w.words LEFT JOIN n ON n.cls = c.cls LEFT JOIN root ON root.cls = c.cls
"""


@query("op9_minhash_dedup", _NEAR_SQL)
def op9_minhash_dedup(spark, sf_dir):
    """Near-duplicate components of all documents at 5-word shingle similarity 0.75."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("first", "text_key")


_NEGATIVES_SQL = """
WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op11_hard_negatives", _NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of the embeddings whose vec_id 50 divides, against all embeddings."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


def _codes_sql() -> str:
    """Two rounds and the last assignment, as common table expressions."""
    sql = """
WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT rid, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM r, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, rid - 1 AS entry, x AS c FROM q WHERE rid <= 64)"""
    for k in range(3):
        sql += f""",
n{k} AS MATERIALIZED (SELECT rid, part, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': entry}}) AS best
      FROM q JOIN b{k} USING (part) GROUP BY rid, part)"""
        if k < 2:
            sql += f""",
s{k} AS (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT q.part, best.e AS entry, x, unnest(range(1, len(x) + 1)) AS i FROM q JOIN n{k} USING (rid, part))
      GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
    return sql + """,
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS sha FROM b2),
c AS (SELECT rid, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM n2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM c JOIN r USING (rid), h
"""


@query("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark, sf_dir):
    """Codes of 16 parts for all embeddings, with codebooks of 64 entries refined twice."""
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


_PASSAGES_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),
g AS (SELECT rid, doc_id, i, substr(hex, 2 * i + 1, 100) AS gram FROM (SELECT rid, doc_id, hex, unnest(range(length(hex) // 2 - 49)) AS i FROM d)),
c AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY gram) AS low FROM g) WHERE low < doc_id),
x AS (SELECT rid, i, max(i) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
s AS (SELECT rid, min(i) AS first, max(i) + 50 AS last FROM (
        SELECT rid, i, count(*) FILTER (before IS NULL OR i > before + 50) OVER (PARTITION BY rid ORDER BY i) AS k FROM x) GROUP BY rid, k),
a AS (SELECT rid, sum(last - first)::BIGINT AS n_removed, count(*) AS n_spans, list(first ORDER BY first) AS firsts, list(last ORDER BY first) AS lasts FROM s GROUP BY rid)
SELECT doc_id, (length(hex) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN hex ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k:
         substr(hex, CASE WHEN k = 0 THEN 1 ELSE 2 * lasts[k] + 1 END,
                2 * (CASE WHEN k = n_spans THEN length(hex) // 2 ELSE firsts[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE lasts[k] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN a USING (rid)
"""


@query("op13_suffix_dedup", _PASSAGES_SQL)
def op13_suffix_dedup(spark, sf_dir):
    """All documents without the 50-byte passages that an earlier document holds."""
    out = suffix_dedup.drop_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", (F.octet_length("kept") + removed).alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
