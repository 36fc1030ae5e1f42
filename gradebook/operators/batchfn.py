"""Model calls over tables (U1-U4) with bounded retry and resume.

A model is any callable ``fn(batch: pandas.DataFrame) -> sequence of str`` that
answers one Arrow batch of rows at a time; it is created once per Python worker
through ``factory``.  Calls run in Spark tasks (``mapInPandas``), so in-flight
work is bounded by partitions x task slots.  Exhausted retries yield the error
sentinel *and* an ``error`` message column instead of failing the job.

Model calls are expensive and not repeatable for free, so ``run_and_store``
writes the results to a table before anything aggregates them, and
``pending`` anti-joins finished keys away on the next run.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradebook import fixed

Model = Callable[["object"], Sequence[str]]


def _with_retry(fn: Model, batch, max_retry: int, sleep: float, error_output: str) -> tuple[list, list]:
    """Outputs and error messages of the rows of ``batch`` (a frame or a list).

    A failing batch is cut in halves until the failing rows stand alone; only those are
    retried and, in the end, marked.  Rows that were answered are never called again.
    """
    n = len(batch)
    for attempt in range(max_retry if n == 1 else 1):
        try:
            out = list(fn(batch))
            if len(out) != n:
                raise ValueError(f"model returned {len(out)} outputs for {n} inputs")
            return out, [None] * n
        except Exception as e:  # noqa: BLE001 - any failure of the user callable is retried
            last = f"{type(e).__name__}: {e}"
            if n == 1 and attempt + 1 < max_retry:
                time.sleep(sleep)
    if n == 1:
        return [error_output], [last]
    out, errors = [], []
    for part in (slice(0, n // 2), slice(n // 2, n)):
        o, e = _with_retry(fn, batch.iloc[part] if hasattr(batch, "iloc") else batch[part], max_retry, sleep, error_output)
        out, errors = out + o, errors + e
    return out, errors


def call_model(
    df: DataFrame,
    factory: Callable[[], Model],
    inputs: list[str],
    output: str = "output",
    max_retry: int = fixed.API_MAX_RETRY,
    retry_sleep: float = fixed.API_RETRY_SLEEP,
    error_output: str = fixed.API_ERROR_OUTPUT,
) -> DataFrame:
    """Add ``output`` (model text) and ``error`` columns.

    ``inputs`` are the columns handed to the model; the whole row is passed
    through.  Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    schema = StructType(list(df.schema.fields) + [
        StructField(output, StringType()), StructField("error", StringType())])

    def run(batches: Iterator) -> Iterator:
        fn = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            out, errors = _with_retry(fn, pdf[inputs], max_retry, retry_sleep, error_output)
            yield pdf.assign(**{output: out, "error": errors})

    return df.mapInPandas(run, schema)


def call_model_multi(
    df: DataFrame,
    factory: Callable[[], Model],
    calls: list[tuple[list[str], str]],
    max_retry: int = fixed.API_MAX_RETRY,
    retry_sleep: float = fixed.API_RETRY_SLEEP,
    error_output: str = fixed.API_ERROR_OUTPUT,
) -> DataFrame:
    """Several model calls per row in one Arrow pass (e.g. both position orders
    of a pairwise game): ``calls`` is a list of (input columns, output column).
    Each output gets its own ``<output>_error`` column."""
    extra = []
    for _, out in calls:
        extra += [StructField(out, StringType()), StructField(f"{out}_error", StringType())]
    schema = StructType(list(df.schema.fields) + extra)

    def run(batches: Iterator) -> Iterator:
        fn = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            pdf = pdf.copy()
            for inputs, out in calls:
                pdf[out], pdf[f"{out}_error"] = _with_retry(fn, pdf[inputs], max_retry, retry_sleep, error_output)
            yield pdf

    return df.mapInPandas(run, schema)


def without_errors(done: DataFrame) -> DataFrame:
    """The stored rows whose calls all succeeded (no text in a column named error, g1_error, ...)."""
    failed = [F.col(c).isNotNull() for c in done.columns if c == "error" or c.endswith("_error")]
    return done.where(~reduce(lambda a, b: a | b, failed)) if failed else done


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``work`` whose key has no finished result yet; a stored error is not a result."""
    return work.join(without_errors(done).select(*keys).distinct(), keys, "left_anti")


def finished(stored: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of a result table: the last success, else the last error (by ``tstamp`` if there is one)."""
    failed = [F.col(c).isNotNull().cast("int") for c in stored.columns if c == "error" or c.endswith("_error")]
    bad = reduce(lambda a, b: a + b, failed) if failed else F.lit(0)
    order = F.struct(-bad, *[F.col(c) for c in ("tstamp",) if c in stored.columns])
    rest = [c for c in stored.columns if c not in keys]
    return stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in rest])


def run_and_store(work: DataFrame, factory: Callable[[], Model], inputs: list[str], keys: list[str],
                  path: str, output: str = "output", **kw) -> DataFrame:
    """Call the model on unfinished rows only and append them to ``path`` (Parquet),
    then return the whole result table read back from storage."""
    from gradebook.session import read_parquet_if_exists
    spark = work.sparkSession
    done = read_parquet_if_exists(spark, path)
    todo = work if done is None else pending(work, done, keys)
    call_model(todo, factory, inputs, output, **kw).write.mode("append").parquet(path)
    return finished(spark.read.parquet(path), keys)


Generator = Callable[[list, list], Sequence[str]]


def generate_answers(
    questions: DataFrame,
    factory: Callable[[], Generator],
    model_id: str,
    stop: str | None = None,
    max_retry: int = fixed.API_MAX_RETRY,
    retry_sleep: float = fixed.API_RETRY_SLEEP,
    error_output: str = fixed.API_ERROR_OUTPUT,
) -> DataFrame:
    """Answer every turn of every question; later turns see earlier outputs.

    ``factory()`` returns ``gen(conversations, temperatures) -> texts`` where a
    conversation is a list of ``(role, text)`` ending with the user turn to
    answer.  Turns are generated batch-wise (turn 1 of all rows, then turn 2 of
    the rows that have one, ...).  The temperature comes from the category (C5);
    outputs are cut at ``stop`` when present (C6) and stripped.
    """
    from gradebook.operators.convert import temperature

    q = questions.select("question_id", "category", "question", temperature("category").alias("temperature"))
    schema = ("question_id long, category string, question array<string>, model_id string, "
              "model_answer array<string>, tstamp double, error string")

    def cut(text: str) -> str:
        if stop and stop in text:
            text = text[: text.find(stop)]
        return text.strip()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        gen = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            turns = [list(t) if t is not None else [] for t in pdf["question"]]
            convs: list[list[tuple[str, str]]] = [[] for _ in turns]
            answers: list[list[str]] = [[] for _ in turns]
            errors: list[str | None] = [None] * len(turns)
            for j in range(max((len(t) for t in turns), default=0)):
                idx = [i for i, t in enumerate(turns) if len(t) > j]
                for i in idx:
                    convs[i].append(("user", turns[i][j]))
                batch = [convs[i] for i in idx]
                temps = [float(pdf["temperature"].iloc[i]) for i in idx]
                both = list(zip(batch, temps, strict=True))
                out, failed = _with_retry(lambda b: gen([c for c, _ in b], [t for _, t in b]), both, max_retry, retry_sleep, error_output)
                for k, i in enumerate(idx):
                    errors[i] = failed[k] or errors[i]
                    text = cut(out[k]) if failed[k] is None else error_output
                    answers[i].append(text)
                    convs[i].append(("assistant", text))
            yield pd.DataFrame({
                "question_id": pdf["question_id"], "category": pdf["category"], "question": pdf["question"],
                "model_id": model_id, "model_answer": answers, "tstamp": time.time(), "error": errors})

    return q.mapInPandas(run, schema)


def generate_turns(work: DataFrame, factory: Callable[[], Generator], stop: str | None = None, max_retry: int = fixed.API_MAX_RETRY,
                   retry_sleep: float = fixed.API_RETRY_SLEEP, error_output: str = fixed.API_ERROR_OUTPUT) -> DataFrame:
    """U2, one turn: ``work`` with a conversation (array of role and text, ending with the turn to answer) and a temperature ->
    text (cut at ``stop``, C6) and error instead of the conversation."""
    from gradebook.functions.text import cut_at, ustrip

    keep = [c for c in work.columns if c not in ("conversation", "temperature")]
    schema = StructType([*[work.schema[c] for c in keep], StructField("text", StringType()), StructField("error", StringType())])

    def run(batches: Iterator) -> Iterator:
        gen = factory()
        for pdf in batches:
            if len(pdf) == 0:
                continue
            both = [([(m["role"], m["text"]) for m in c], float(t)) for c, t in zip(pdf["conversation"], pdf["temperature"], strict=True)]
            out, errors = _with_retry(lambda b: gen([c for c, _ in b], [t for _, t in b]), both, max_retry, retry_sleep, error_output)
            yield pdf[keep].assign(text=out, error=errors)

    done = work.mapInPandas(run, schema)
    cut = ustrip("text") if stop is None else cut_at("text", stop)
    return done.withColumn("text", F.when(F.col("error").isNull(), cut).otherwise(F.col("text")))


# ---------------------------------------------------------------------------
# Deterministic offline judge (tests, examples and the judge_map query)
# ---------------------------------------------------------------------------

def length_judge_factory() -> Model:
    """Judge that prefers the longer first-turn answer: ``[[A]]``/``[[B]]``/``[[C]]``."""

    def judge(batch):
        a = batch.iloc[:, 0].fillna("").str.len()
        b = batch.iloc[:, 1].fillna("").str.len()
        return [
            "Assistant A is more complete. [[A]]" if x > y else
            "Assistant B is more complete. [[B]]" if x < y else
            "Both answers are equally complete. [[C]]"
            for x, y in zip(a, b)
        ]

    return judge


def echo_generator_factory(stop: str = "</s>") -> Callable[[], Generator]:
    """Offline generator for tests and the answer_generation query: each reply
    names the temperature, the conversation length so far and the last user
    text, followed by a stop marker and junk that the runner cuts off."""

    def factory() -> Generator:
        def gen(convs, temps):
            return [f"t={t} n={len(c)} last={c[-1][1]}{stop}tail" for c, t in zip(convs, temps)]
        return gen

    return factory
