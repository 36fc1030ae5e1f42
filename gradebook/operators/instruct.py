"""Instruction-data curation jobs (I1-I6): seed prompts, parsing generated
question lists, novelty filtering, rating parsing and the quality gate.

All steps are projections, one group-by or one anti-join; duplicate groups are
collapsed with partial aggregates, so a text copied millions of times never
gathers its copies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.functions.text import normalize_text, ustrip
from gradebook.operators.convert import with_position

# Own wording of the expansion instruction (the protocol only fixes its shape:
# an instruction followed by a numbered list of seed questions).
SEED_INSTRUCTION = (
    "Using the reference questions below, write new questions about IT operations. "
    "Each new question must differ from the references and from the others; give "
    "only the questions, as a numbered list.\nReference questions:\n"
)
RATING_INSTRUCTION = (
    "Rate the following instruction record from 1 (poor) to 5 (excellent) for domain fit, "
    "clarity, answer accuracy, usefulness, fluency and difficulty. Reply with JSON only: "
    "{\"score\": n, \"reason\": \"...\", \"modified_data\": ...}. When the score is below 4, "
    "put an improved record in modified_data, otherwise the text None.\nRecord:\n"
)
KEEP_SCORE = 4
NUMBERED_ITEM = r"(?m)^[\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]*\d+\.[\t\n\x{0b}\f\r\x{1c}-\x{1f}\x{85}\p{Z}]*"


def seed_prompts(seeds: DataFrame, id_col: str, text_col: str, k: int,
                 instruction: str = SEED_INSTRUCTION) -> DataFrame:
    """Groups of ``k`` consecutive seeds (in id order) -> one expansion prompt.

    Positions come from the two-pass numbering (no single-task window); each
    group holds at most ``k`` rows, so the ordered ``collect_list`` is bounded.
    """
    pos = with_position(seeds.select(id_col, text_col), id_col, "_pos")
    g = pos.select((F.col("_pos") / F.lit(k)).cast("long").alias("group_id"),
                   (F.col("_pos") % k + 1).alias("i"), F.col(text_col).alias("t"))
    agg = g.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("items"))
    listing = F.array_join(F.transform("items", lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["t"])), "\n")
    return agg.select("group_id", F.size("items").alias("n_seeds"),
                      F.concat(F.lit(instruction), listing).alias("prompt"))


def parse_numbered(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Split a numbered list into one row per item (stripped, blanks dropped)."""
    parts = F.posexplode(F.split(F.col(text_col), NUMBERED_ITEM))
    out = df.select(key, parts.alias("item_pos", "raw"))
    return (out.select(key, F.col("item_pos").cast("long").alias("item_pos"), ustrip("raw").alias("item"))
            .filter(F.length("item") > 0))


def new_and_distinct(items: DataFrame, seeds: DataFrame, key: str, seed_text: str) -> DataFrame:
    """One row per normalised item text that is not a seed; the first copy
    (smallest key, position) is kept and the number of copies reported."""
    n = items.select(key, "item_pos", normalize_text("item").alias("norm"))
    firsts = n.groupBy("norm").agg(F.min(F.struct(key, "item_pos")).alias("first"),
                                   F.count("*").alias("n_copies"))
    seen = seeds.select(normalize_text(seed_text).alias("norm")).distinct()
    fresh = firsts.join(seen, "norm", "left_anti")
    return fresh.select("norm", F.col(f"first.{key}").alias(key), F.col("first.item_pos").alias("item_pos"),
                        "n_copies")


def rating_prompt(df: DataFrame, instruction: str = RATING_INSTRUCTION) -> DataFrame:
    """I4: rating prompt = instruction + the record as JSON."""
    rec = F.to_json(F.struct("instruction", "input", "output"), {"ignoreNullFields": "false"})
    return df.withColumn("rating_prompt", F.concat(F.lit(instruction), rec))


def parse_rating(df: DataFrame, text_col: str = "rating_text") -> DataFrame:
    """Parse the rating JSON (score, reason, optional rewrite).

    Unparseable text gives null fields (tested field-wise: a struct of nulls is
    not null).  A rewrite of ``"None"`` is no rewrite.
    """
    outer = F.from_json(F.col(text_col), "score int, reason string, modified_data string")
    inner = F.from_json(F.col("_r.modified_data"), "instruction string, input string, output string")
    p = df.withColumn("_r", outer).withColumn("_m", inner)
    has = F.col("_m.instruction").isNotNull() | F.col("_m.output").isNotNull()
    return p.select(
        *[c for c in df.columns],
        F.col("_r.score").alias("score"), F.col("_r.reason").alias("reason"),
        F.col("_r.score").between(1, 5).alias("score_ok"),
        F.coalesce(has, F.lit(False)).alias("has_rewrite"),
        F.col("_m.instruction").alias("new_instruction"), F.col("_m.input").alias("new_input"),
        F.col("_m.output").alias("new_output"))


def decision(score: Column, score_ok: Column, has_rewrite: Column, keep_score: int = KEEP_SCORE) -> Column:
    return (F.when(score.isNull() | ~F.coalesce(score_ok, F.lit(False)), F.lit("reject"))
            .when(score >= keep_score, F.lit("keep"))
            .when(has_rewrite, F.lit("rewrite"))
            .otherwise(F.lit("reject")))


def quality_gate(records: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Keep (score >= 4), replace by the rewrite (< 4 with rewrite), or reject; records without a rating are rejected."""
    j = records.join(parsed, key, "left")
    d = decision(F.col("score"), F.col("score_ok"), F.col("has_rewrite"))
    rw = d == "rewrite"
    return j.select(
        key, d.alias("decision"), "score",
        F.when(rw, F.col("new_instruction")).otherwise(F.col("instruction")).alias("instruction"),
        F.when(rw, F.col("new_input")).otherwise(F.col("input")).alias("input"),
        F.when(rw, F.col("new_output")).otherwise(F.col("output")).alias("output"))
