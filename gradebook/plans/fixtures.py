"""Evaluation-shaped views derived from the driver's tables (see FIXTURES.md).

Every view is a lazy DataFrame over the Parquet tables, so its size grows with the
scale factor.  The same rules are written as DuckDB SQL in ``oracle_views`` for the
correctness oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.functions.text import pick

# Fixture rules (not protocol constants): category cycle of derived questions.
CATEGORY_CYCLE = [
    "writing", "roleplay", "extraction", "math", "coding",
    "reasoning", "stem", "humanities", "generic",
]
MC_RUNS = [("mA", 0, False), ("mA", 5, False), ("mB", 5, True)]
MODELS = ["m0", "m1", "m2", "m3"]
STOP_MARKER = "</s>"


# Fact tables whose per-row work (regexes over whole texts, verdict parsing) is
# worth spreading when a file arrives as a single split.
SPREAD_TABLES = {"documents", "lineitem", "orders", "events", "conversations", "pages"}


_SPLITS: dict[tuple, int] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    if name not in SPREAD_TABLES:
        return df
    try:
        cores = spark.sparkContext.defaultParallelism
        key = (path, cores, spark.conf.get("spark.sql.files.maxPartitionBytes"))
        # The split count of a scan depends only on the files and the split
        # settings: plan it once per path, not once per reference in a query.
        if key not in _SPLITS:
            _SPLITS[key] = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no SparkContext/RDD view (e.g. Spark Connect)
        return df
    # Same rule as session.ensure_parallelism: spread only an under-split input.
    return df if _SPLITS[key] >= cores else df.repartition(cores)


def _m(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


# ---------------------------------------------------------------------------
# QA side
# ---------------------------------------------------------------------------

def raw_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("text")).alias("instruction"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("input"),
        F.col("source").alias("output"),
        F.col("lang").alias("ops_field"),
        F.col("source").alias("task_type"),
        F.col("doc_id").alias("seq"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per conversation; turns = user texts in turn order."""
    conv = table(spark, sf_dir, "conversations")
    q = (conv.filter(F.col("role") == "user")
         .groupBy("conv_id")
         .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")))
    return q.select(
        F.col("conv_id").alias("question_id"),
        pick(CATEGORY_CYCLE, F.col("conv_id") % 9).alias("category"),
        _m("f", F.col("conv_id") % 5).alias("ops_field"),
        _m("t", F.col("conv_id") % 3).alias("task_type"),
        F.transform("t", lambda x: x["text"]).alias("question"),
        F.col("conv_id").alias("seq"),
    )


def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference answers = assistant texts of each conversation, in turn order."""
    conv = table(spark, sf_dir, "conversations")
    r = (conv.filter(F.col("role") == "assistant")
         .groupBy("conv_id")
         .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t")))
    return r.select(
        F.col("conv_id").alias("question_id"),
        F.lit("expert").alias("model_id"),
        F.transform("t", lambda x: x["text"]).alias("model_answer"),
    )


def answer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only answer log (many duplicates) from every event: its user, modulo the largest
    question id plus one, is the question.  Questions with ``id % 5 = 0`` are never answered by m3,
    which leaves gaps for the completeness check."""
    ev = table(spark, sf_dir, "events")
    n = table(spark, sf_dir, "conversations").agg(F.max("conv_id")).first()[0]
    ev = ev.withColumn("user_id", F.pmod("user_id", F.lit((n or 0) + 1)))
    a1 = F.concat(
        F.col("event_type"), F.lit(" answer "), F.col("event_id").cast("string"),
        F.when(F.col("event_id") % 5 == 0, F.lit(f"{STOP_MARKER} trailing text")).otherwise(F.lit("")),
    )
    a2 = F.concat(F.col("event_type"), F.lit(" follow-up "), F.col("event_id").cast("string"))
    n_models = F.when(F.col("user_id") % 5 == 0, F.lit(3)).otherwise(F.lit(4))
    return ev.select(
        F.col("user_id").alias("question_id"),
        _m("m", F.col("event_id") % n_models).alias("model"),
        F.array(a1, a2).alias("model_answer"),
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("double").alias("tstamp"),
    )


def question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("question_id"),
        F.col("c_mktsegment").alias("label"),
        _m("n", F.col("c_nationkey") % 5).alias("label2"),
        pick(CATEGORY_CYCLE, F.col("c_custkey") % 9).alias("category"),
        (F.lit(1) + F.col("c_custkey") % 2).cast("int").alias("n_turns"),
    )


def single_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-answer judgments of two benches, about the questions of ``question_labels``; verdict text shape
    chosen by l_partkey % 7, file order by ``seq``."""
    li = table(spark, sf_dir, "lineitem")
    asked = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 1
    qid = F.lit(1) + F.col("l_orderkey") % asked
    n = (F.col("l_linenumber") + 1).cast("string")
    n1 = (F.col("l_linenumber") + 2).cast("string")
    k = F.col("l_partkey") % 7
    text = (
        F.when(k == 0, F.concat(F.lit("Rating: [["), n, F.lit("]]")))
        .when(k == 1, F.concat(F.lit("Rating: ["), n, F.lit("]")))
        .when(k == 2, F.concat(F.lit("Rating: [["), n, F.lit(".5]]")))
        .when(k == 3, F.lit("No rating given"))
        .when(k == 4, F.lit("$ERROR$"))
        .when(k == 5, F.concat(F.lit("First [["), n, F.lit("]] then [["), n1, F.lit("]]")))
        .otherwise(F.concat(F.lit("Rating: [[0"), n, F.lit("]]")))
    )
    turn = (F.lit(1) + F.col("l_linenumber") % 2).cast("int")
    return li.select(
        qid.cast("long").alias("question_id"),
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("bench_b")).otherwise(F.lit("bench_a")).alias("bench"),
        _m("m", F.col("l_suppkey") % 6).alias("model"),
        F.lit("gpt-4").alias("judge_model"),
        F.when(turn == 1, F.lit("single-v1")).otherwise(F.lit("single-v1-multi-turn")).alias("judge_prompt"),
        F.concat(F.lit("Question "), (F.col("l_orderkey") % 1000).cast("string"),
                 F.lit(" answered by "), _m("m", F.col("l_suppkey") % 6)).alias("user_prompt"),
        text.alias("judgment"),
        turn.alias("turn"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"),
    )


def pair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise judgments (two games each) from orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    m1 = k % 4
    m2 = (k % 4 + 1 + F.expr("o_orderkey div 4") % 3) % 4
    g1k = k % 5
    g1 = (F.when(g1k == 0, F.lit("Assistant A is better. [[A]]"))
          .when(g1k == 1, F.lit("Assistant B is better. [[B]]"))
          .when(g1k == 2, F.lit("Both are equal. [[C]]"))
          .when(g1k == 3, F.lit("Torn: [[A]] or maybe [[B]]"))
          .otherwise(F.lit("I cannot decide.")))
    g2k = k % 7
    g2 = (F.when(g2k == 0, F.lit("Verdict: [[A]]"))
          .when(g2k == 1, F.lit("Verdict: [[B]]"))
          .when(g2k == 2, F.lit("Verdict: [[C]]"))
          .when(g2k == 3, F.lit("[[B]] first, final [[A]]"))
          .when(g2k == 4, F.lit("Verdict [A]"))
          .when(g2k == 5, F.lit("verdict [[a]]"))
          .otherwise(F.lit("$ERROR$")))
    st = F.col("o_orderstatus")
    judge_model = F.when(st == "F", F.lit("gpt-4")).otherwise(F.lit("gpt-3.5-turbo"))
    base = F.when(st == "P", F.lit("pair-math-v1")).otherwise(F.lit("pair-v2"))
    multi = k % 2 == 1
    judge_prompt = F.concat(base, F.when(multi, F.lit("-multi-turn")).otherwise(F.lit("")))
    qid = F.col("o_custkey")
    return o.select(
        qid.alias("question_id"),
        F.when(k % 3 == 0, F.lit("bench_b")).otherwise(F.lit("bench_a")).alias("bench"),
        _m("m", m1).alias("model_1"),
        _m("m", m2).alias("model_2"),
        judge_model.alias("judge_model"),
        judge_prompt.alias("judge_prompt"),
        F.concat(F.lit("Compare answers to question "), qid.cast("string")).alias("g1_user_prompt"),
        F.concat(F.lit("Compare answers (swapped) to question "), qid.cast("string")).alias("g2_user_prompt"),
        g1.alias("g1_judgment"),
        g2.alias("g2_judgment"),
        F.when(multi, F.lit(2)).otherwise(F.lit(1)).cast("int").alias("turn"),
        k.alias("seq"),
        k.cast("double").alias("tstamp"),
    )


def judgment_stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single judgments in event-time order, one per event (the streaming source)."""
    ev = table(spark, sf_dir, "events")
    n = (F.floor("value") % 10 + 1).cast("string")
    return ev.select(
        F.col("user_id").alias("question_id"),
        _m("m", F.col("event_id") % 4).alias("model"),
        F.lit("gpt-4").alias("judge_model"),
        F.lit("single-v1").alias("judge_prompt"),
        F.concat(F.lit("Event "), F.col("event_type")).alias("user_prompt"),
        F.concat(F.lit("Rating: [["), n, F.lit("]]")).alias("judgment"),
        F.lit(1).alias("turn"),
        epoch_seconds_ntz("ts").alias("tstamp"),
    )


def epoch_seconds_ntz(c: str) -> F.Column:
    """Epoch seconds of a TIMESTAMP_NTZ wall-clock value read as UTC, independent
    of the session time zone."""
    us = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(c))
    return us / F.lit(1_000_000.0)


def two_score_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-score judgments ``[[x,y]]`` and their edge shapes, from orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    x = (k % 10).cast("string")
    y = (F.expr("o_orderkey div 10") % 10).cast("string")
    s = k % 6
    text = (F.when(s == 0, F.concat(F.lit("Scores [["), x, F.lit(","), y, F.lit("]]")))
            .when(s == 1, F.concat(F.lit("Scores [["), x, F.lit(", "), y, F.lit(".9]]")))
            .when(s == 2, F.concat(F.lit("Scores ["), x, F.lit(", "), y, F.lit("]")))
            .when(s == 3, F.lit("Scores [[0.4,0.3]]"))
            .when(s == 4, F.concat(F.lit("Scores [["), x, F.lit(","), x, F.lit(".05]]")))
            .otherwise(F.lit("No scores")))
    return o.select(k.alias("seq"), F.col("o_custkey").alias("question_id"), text.alias("judgment"))


# ---------------------------------------------------------------------------
# Multiple-choice side
# ---------------------------------------------------------------------------

def mc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("A"),
        F.col("p_type").alias("B"),
        F.col("p_size").cast("string").alias("C"),
        F.round(F.col("p_retailprice") * 100).cast("long").cast("string").alias("D"),
        pick(["A", "B", "C", "D"], F.col("p_partkey") % 4).alias("answer"),
        _m("s", F.col("p_partkey") % 5).alias("subject"),
        F.col("p_type").alias("category"),
        # Dev/val split: a tenth of the items (every subject) are few-shot examples.
        (F.col("p_partkey") % 50 < 5).alias("is_shot"),
    )


def mc_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mc_items(spark, sf_dir).filter(~F.col("is_shot")).drop("is_shot")


def mc_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mc_items(spark, sf_dir).filter(F.col("is_shot")).drop("is_shot")


def mc_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three model runs over the validation items with varied response shapes."""
    q = mc_questions(spark, sf_dir)
    runs = F.explode(F.array(*[
        F.struct(F.lit(i).alias("run"), F.lit(m).alias("model"), F.lit(n).alias("ntrain"), F.lit(c).alias("cot"))
        for i, (m, n, c) in enumerate(MC_RUNS)
    ]))
    q = q.select("*", runs.alias("r")).select("*", "r.*").drop("r")
    v = (F.col("id") + F.col("run")) % 10
    letter = pick(["A", "B", "C", "D"], (F.expr("id div 3") + F.col("run")) % 4)
    other = pick(["A", "B", "C", "D"], (F.expr("id div 3") + F.col("run") + 1) % 4)
    resp = (F.when(v == 0, letter)
            .when(v == 1, F.concat(F.lit("The answer is "), letter, F.lit(".")))
            .when(v == 2, F.concat(F.lit("答案是："), letter))
            .when(v == 3, F.concat(F.lit("选项说明，answer is （"), letter, F.lit("）")))
            .when(v == 4, F.concat(F.lit("答案是"), other, F.lit("，不对，答案是"), letter))
            .when(v == 5, F.lit("I have no idea."))
            .when(v == 6, F.lit("   "))
            .when(v == 7, F.concat(F.lit("　　"), letter))
            .when(v == 8, F.concat(F.lit("Because the answer is "), letter))
            .otherwise(F.concat(F.lit("the answer is The "), letter)))
    return q.withColumn("model_output", resp)


def mc_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored runs (all outputs, letters extracted, correctness flagged)."""
    from gradebook.functions.extract import letter_correct, mc_letter
    o = mc_outputs(spark, sf_dir).withColumn("letter", mc_letter("model_output"))
    return o.withColumn("correct", letter_correct("letter", "answer"))


# ---------------------------------------------------------------------------
# Instruction data
# ---------------------------------------------------------------------------

def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating JSON texts for labelled documents (rewrite on even ids, junk on 13k)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id")
    score = (F.lit(1) + F.lit(3) * F.col("quality") + (F.lit(1) - F.col("toxic"))).cast("string")
    ids = F.col("doc_id").cast("string")
    rewrite = F.concat(
        F.lit('{"instruction": "improved instruction '), ids,
        F.lit('", "input": "", "output": "improved output '), ids, F.lit('"}'))
    body = F.concat(
        F.lit('{"score": '), score, F.lit(', "reason": "reason '), ids, F.lit('", "modified_data": '),
        F.when(F.col("doc_id") % 2 == 0, rewrite).otherwise(F.lit('"None"')), F.lit("}"))
    junk = F.concat(F.lit('{"score": '), score, F.lit(', "reason": "cut off'))
    return j.select("doc_id", F.when(F.col("doc_id") % 13 == 0, junk).otherwise(body).alias("rating_text"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs shaped as numbered question lists: each document line numbered."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_replace("text", r"(?m)^", "1. ").alias("generated"))
