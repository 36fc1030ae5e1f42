"""Instruction-data queries (I1-I6) and distribution / sequence cuts."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import functions as F

from gradebook.functions.templates import sql_literal
from gradebook.operators import instruct as I
from gradebook.operators import shares as S
from gradebook.plans import fixtures as fx
from gradebook.plans.oracle_views import with_views
from gradebook.plans.registry import register
from gradebook.plans.sql_snippets import ustrip_sql
from gradebook.functions.text import PY_WS

SEED_K = 3
SHARE_P = 0.6
END_MARKER = "License."
MAX_LEN = 2048


@register("seed_prompts", f"""
WITH p AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark),
g AS (SELECT CAST(pos // {SEED_K} AS BIGINT) AS group_id, pos % {SEED_K} + 1 AS i, text FROM p)
SELECT group_id, CAST(count(*) AS INTEGER) AS n_seeds,
       {sql_literal(I.SEED_INSTRUCTION)} || string_agg(CAST(i AS VARCHAR) || '. ' || text, chr(10) ORDER BY i) AS prompt
FROM g GROUP BY group_id""")
def seed_prompts(spark, sf):
    b = fx.table(spark, sf, "benchmark")
    return I.seed_prompts(b, "item_id", "text", SEED_K)


_ITEMS = f"""items AS (
  SELECT doc_id, CAST(item_pos - 1 AS BIGINT) AS item_pos, {ustrip_sql("raw")} AS item FROM (
    SELECT doc_id, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS item_pos FROM (
      SELECT doc_id, regexp_split_to_array(generated, '(?m)^{PY_WS}*\\d+\\.{PY_WS}*') AS parts FROM generations)))"""


@register("generated_rows", with_views(["generations"], f"""
, {_ITEMS}
SELECT * FROM items WHERE length(item) > 0""".lstrip()))
def generated_rows(spark, sf):
    return I.parse_numbered(fx.generations(spark, sf), "doc_id", "generated")


def _norm_sql(x: str) -> str:
    return ustrip_sql(f"regexp_replace(lower({x}), '{PY_WS}+', ' ', 'g')")


@register("generated_new", with_views(["generations"], f"""
, {_ITEMS},
n AS (SELECT doc_id, item_pos, {_norm_sql("item")} AS norm FROM items WHERE length(item) > 0),
f AS (SELECT norm, arg_min(doc_id, (doc_id, item_pos)) AS doc_id, arg_min(item_pos, (doc_id, item_pos)) AS item_pos,
             count(*) AS n_copies FROM n GROUP BY norm)
SELECT * FROM f WHERE norm NOT IN (SELECT {_norm_sql("text")} FROM benchmark)""".lstrip()))
def generated_new(spark, sf):
    items = I.parse_numbered(fx.generations(spark, sf), "doc_id", "generated")
    return I.new_and_distinct(items, fx.table(spark, sf, "benchmark"), "doc_id", "text")


_PARSED = """parsed AS (
  SELECT doc_id,
         CASE WHEN json_valid(rating_text) THEN try_cast(json_extract_string(rating_text, '$.score') AS INTEGER) END AS score,
         CASE WHEN json_valid(rating_text) THEN json_extract_string(rating_text, '$.reason') END AS reason,
         CASE WHEN json_valid(rating_text) THEN json_extract_string(rating_text, '$.modified_data.instruction') END AS new_instruction,
         CASE WHEN json_valid(rating_text) THEN json_extract_string(rating_text, '$.modified_data.input') END AS new_input,
         CASE WHEN json_valid(rating_text) THEN json_extract_string(rating_text, '$.modified_data.output') END AS new_output
  FROM ratings),
p2 AS (SELECT *, score BETWEEN 1 AND 5 AS score_ok,
              (new_instruction IS NOT NULL OR new_output IS NOT NULL) AS has_rewrite FROM parsed)"""


@register("rating_parsed", with_views(["ratings"], f"""
, {_PARSED}
SELECT doc_id, score, reason, score_ok, has_rewrite, new_instruction, new_input, new_output FROM p2""".lstrip()))
def rating_parsed(spark, sf):
    p = I.parse_rating(fx.ratings(spark, sf))
    return p.select("doc_id", "score", "reason", "score_ok", "has_rewrite", "new_instruction", "new_input",
                    "new_output")


_GATE = """gate AS (
  SELECT r.seq AS doc_id,
    CASE WHEN p2.score IS NULL OR NOT p2.score_ok THEN 'reject' WHEN p2.score >= 4 THEN 'keep'
         WHEN p2.has_rewrite THEN 'rewrite' ELSE 'reject' END AS decision,
    p2.score, r.instruction, r.input, r.output, p2.new_instruction, p2.new_input, p2.new_output
  FROM raw_qa r LEFT JOIN p2 ON r.seq = p2.doc_id)"""


@register("quality_gate", with_views(["ratings", "raw_qa"], f"""
, {_PARSED}, {_GATE}
SELECT doc_id, decision, score,
       CASE WHEN decision = 'rewrite' THEN new_instruction ELSE instruction END AS instruction,
       CASE WHEN decision = 'rewrite' THEN new_input ELSE input END AS input,
       CASE WHEN decision = 'rewrite' THEN new_output ELSE output END AS output
FROM gate""".lstrip()))
def quality_gate(spark, sf):
    raw = fx.raw_qa(spark, sf).withColumnRenamed("seq", "doc_id")
    return I.quality_gate(raw, I.parse_rating(fx.ratings(spark, sf)), "doc_id")


@register("quality_counts", with_views(["ratings", "raw_qa"], f"""
, {_PARSED}, {_GATE}
SELECT score, decision, count(*) AS n FROM gate GROUP BY score, decision""".lstrip()))
def quality_counts(spark, sf):
    g = quality_gate(spark, sf)
    return g.groupBy("score", "decision").agg(F.count("*").alias("n"))


@register("rating_prompts", with_views(["raw_qa"], f"""
SELECT seq AS doc_id, {sql_literal(I.RATING_INSTRUCTION)} || to_json(struct_pack(instruction := instruction, input := input, output := output)) AS rating_prompt
FROM raw_qa"""))
def rating_prompts(spark, sf):
    r = I.rating_prompt(fx.raw_qa(spark, sf))
    return r.select(F.col("seq").alias("doc_id"), "rating_prompt")


# ---------------------------------------------------------------------------
# R1, R2
# ---------------------------------------------------------------------------

@register("share_cut", f"""
WITH v AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice AS v FROM lineitem),
c AS (SELECT *, fsum(v) OVER (PARTITION BY l_orderkey) AS total,
             coalesce(fsum(v) OVER (PARTITION BY l_orderkey ORDER BY v DESC, l_partkey, l_suppkey, l_linenumber,
                          l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
k AS (SELECT * FROM c WHERE before * {Fraction(str(SHARE_P)).denominator} <= total * {Fraction(str(SHARE_P)).numerator})
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(v / total, 9) AS share,
       round(v / fsum(v) OVER (PARTITION BY l_orderkey), 9) AS kept_share FROM k""")
def share_cut(spark, sf):
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                "l_quantity", "l_extendedprice")
    k = S.cumulative_share_cut(li, "l_orderkey", "l_extendedprice", SHARE_P,
                               ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"])
    return k.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round("share", 9).alias("share"),
                    F.round("kept_share", 9).alias("kept_share"))


@register("sequence_cut", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{S.TOKEN_PATTERN}') AS tok FROM documents),
p AS (SELECT doc_id, tok, len(tok) AS n, list_position(tok, {sql_literal(END_MARKER)}) AS pos FROM t),
k AS (SELECT *, least(CASE WHEN pos IS NOT NULL AND pos > 0 THEN pos - 1 ELSE n END, {MAX_LEN}) AS kept FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n_tokens, CAST(CASE WHEN pos > 0 THEN pos END AS BIGINT) AS end_pos,
       CAST(kept AS BIGINT) AS kept_tokens, array_to_string(tok[1:kept], ' ') AS kept_text FROM k""")
def sequence_cut(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    return S.sequence_cut(d, "text", END_MARKER, MAX_LEN).drop("text")
