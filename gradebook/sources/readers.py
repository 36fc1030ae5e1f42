"""Readers for the evaluation file layouts (S1-S8; the judgment log is ``judgment_log``).

Every reader adds an explicit ``seq`` column for "file order" semantics (keep-last,
running ids, first-n shots): ``(file path, block start, row id)``, which is a
total order matching the order lines were appended, independent of how Spark
packs file splits into tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.operators.joins import collect_small

QUESTION_SCHEMA = "question_id long, category string, ops_field string, task_type string, question array<string>"
ANSWER_SCHEMA = ("question_id long, answer_id string, model_id string, category string, question array<string>, "
                 "model_answer array<string>, answer array<string>, tstamp double")
JUDGE_PROMPT_SCHEMA = ("name string, type string, system_prompt string, prompt_template string, "
                       "description string, category string, output_format string")
MC_SCHEMA = "id string, question string, A string, B string, C string, D string, answer string, category string"


def file_seq() -> Column:
    """(file path, split start, row id): append order across and within files."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def stem(path_col: Column, ext: str) -> Column:
    return F.regexp_extract(path_col, rf"([^/]+)\.{ext}$", 1)


def read_raw_qa_csv(spark: SparkSession, path: str, field_header: str = "ops_field",
                    task_header: str = "task_type") -> DataFrame:
    """Raw QA CSV (quoted multi-line cells); domain/task headers are parameters."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .csv(path))
    df = df.select("*", file_seq().alias("seq"))
    return df.select(
        F.col("instruction").cast("string"), F.col("input").cast("string"), F.col("output").cast("string"),
        F.col(f"`{field_header}`").alias("ops_field"), F.col(f"`{task_header}`").alias("task_type"), "seq")


def read_questions(spark: SparkSession, path: str, begin: int | None = None, end: int | None = None) -> DataFrame:
    """S2 (+ S4): question JSONL (explicit schema, no inference), optionally the
    Python-style slice ``[begin:end]`` of the file order."""
    df = spark.read.schema(QUESTION_SCHEMA).json(path).select("*", file_seq().alias("seq"))
    if begin is None and end is None:
        return df
    from gradebook.operators.convert import python_slice
    return python_slice(df, "seq", begin, end)


def read_answers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """S3: answer JSONL files, one per model; the model is the file stem, or in a folder of ``writers.append_answers``
    (whose file names tell nothing) the ``model_id`` of the row.

    ``answer`` is accepted as the reference-answer key (D1): ``model_answer`` is
    coalesced with it.
    """
    df = spark.read.schema(ANSWER_SCHEMA).json(paths)
    return df.select(
        "question_id", F.coalesce(F.nullif(stem(F.col("_metadata.file_path"), "jsonl"), F.lit("")), "model_id").alias("model"),
        F.coalesce("model_answer", "answer").alias("model_answer"), "tstamp", file_seq().alias("seq"))


def read_judge_prompts(spark: SparkSession, path: str) -> dict[str, dict]:
    """S5 + K2: catalog keyed by name, the last line of a name winning (small)."""
    df = spark.read.schema(JUDGE_PROMPT_SCHEMA).json(path).select("*", file_seq().alias("seq"))
    rows = sorted(collect_small(df, 10_000), key=lambda r: (r["seq"]["file"], r["seq"]["block"], r["seq"]["row"]))
    out: dict[str, dict] = {}
    for r in rows:
        d = r.asDict()
        d.pop("seq")
        out[d["name"]] = d
    return out


def read_mc_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Multiple-choice CSV files; ``subject`` is the file stem.

    All cells are read as text (verbatim option strings, D17).
    """
    # enforceSchema off: a file whose header has other names or another order is an error.
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
          .schema(MC_SCHEMA).csv(pattern))
    return df.select("*", stem(F.col("_metadata.file_path"), "csv").alias("subject"), file_seq().alias("seq"))


def subject_counts(mc: DataFrame) -> DataFrame:
    """Rows per subject."""
    return mc.groupBy("subject").agg(F.count("*").alias("n"))


RESULT_PATH = r"/([^/]+)/ntrain=([^/]+)/cot=([^/]+)/([^/]+)_res\.csv$"


def _run_keys(path: Column) -> dict[str, Column]:
    return {"model": F.regexp_extract(path, RESULT_PATH, 1), "ntrain": F.regexp_extract(path, RESULT_PATH, 2).cast("int"),
            "cot": F.lower(F.regexp_extract(path, RESULT_PATH, 3)) == "true", "subject": F.regexp_extract(path, RESULT_PATH, 4)}


def mc_run_checks(spark: SparkSession, root: str, exclude_models: list[str] | None = None) -> DataFrame:
    """S8 leaf rule, per (model, ntrain, cot) run: ``n_files``, ``files`` and ``problem`` (null for a good run).

    A good run has one file, and its header is the one that most runs have (of several, the smallest).  Only the first line of
    each file is compared.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*_res.csv").text(root)
    p = F.col("_metadata.file_path")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    heads = lines.select(p.alias("file"), F.regexp_replace("value", "^\\x{feff}", "").alias("line"), place.alias("place")) \
        .groupBy("file").agg(F.min_by("line", "place").alias("header"))
    heads = heads.select("*", *[c.alias(k) for k, c in _run_keys(F.col("file")).items()])
    if exclude_models:
        heads = heads.filter(~F.col("model").isin(*exclude_models))
    usual = heads.groupBy("header").agg(F.countDistinct("model", "ntrain", "cot").alias("n")).orderBy(F.desc("n"), "header").first()
    runs = heads.groupBy("model", "ntrain", "cot").agg(
        F.count("*").alias("n_files"), F.sort_array(F.collect_set("file")).alias("files"),       # the files of one folder
        F.max(~F.col("header").eqNullSafe(usual["header"] if usual else None)).alias("other"))
    problem = F.when(F.col("n_files") > 1, F.concat(F.col("n_files").cast("string"), F.lit(" result files in one run"))) \
        .when(F.col("other"), F.lit("another header than the other runs"))
    return runs.select("model", "ntrain", "cot", "n_files", "files", problem.alias("problem"))


def read_mc_results(spark: SparkSession, root: str, exclude_models: list[str] | None = None, bad_runs: str = "raise") -> DataFrame:
    """``<root>/<model>/ntrain=<n>/cot=<b>/<subject>_res.csv`` result trees.

    The model level is not ``key=value``, so partition discovery cannot be used;
    the run keys are parsed from each row's file path instead.  Runs that break the leaf rule (``mc_run_checks``) are an
    error that names them, or with ``bad_runs="drop"`` are left out.  Columns are bound by the header that good runs share.
    """
    if bad_runs not in ("raise", "drop"):
        raise ValueError("bad_runs is raise or drop")
    checks = mc_run_checks(spark, root, exclude_models)
    bad = checks.where("problem is not null").orderBy("model", "ntrain", "cot")
    if bad_runs == "raise" and (some := bad.limit(5).collect()):
        raise ValueError("; ".join(f"{r.model}/ntrain={r.ntrain}/cot={r.cot}: {r.problem} ({', '.join(r.files)})" for r in some))
    reader = (spark.read.option("recursiveFileLookup", "true").option("header", True).option("multiLine", True)
              .option("escape", '"').option("pathGlobFilter", "*_res.csv"))
    good = checks.where("problem is null").select(F.explode("files").alias("file")).limit(1).collect()
    if not good:
        raise ValueError(f"no good runs under {root}")
    # The columns are those of a good run's header; good runs all have it, others are not read below.
    names = reader.csv(good[0]["file"]).columns
    df = reader.schema(", ".join(f"`{c}` string" for c in names)).csv(root)
    p = F.col("_metadata.file_path")
    keys = _run_keys(p)
    correct = F.col("correct").cast("int") if bad_runs == "raise" else F.col("correct").try_cast("int")     # bad files are read, then dropped
    out = df.select(*[c for c in names if c != "correct" and c not in keys], *[c.alias(k) for k, c in keys.items()], p.alias("result_file"),
                    correct.alias("correct"))
    if exclude_models:
        out = out.filter(~F.col("model").isin(*exclude_models))
    if bad_runs == "drop":
        out = out.join(bad.select("model", "ntrain", "cot"), ["model", "ntrain", "cot"], "left_anti")
    return out


def leaf_file_counts(results: DataFrame) -> DataFrame:
    """Result files per (model, ntrain, cot) run folder, of rows already read."""
    return results.groupBy("model", "ntrain", "cot").agg(F.countDistinct("result_file").alias("n_files"))
