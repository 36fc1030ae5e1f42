"""Token accounting of chat messages (T1) as Column arithmetic.

The tokenizer is pluggable: any ``Column -> Column(long)`` function.  The default
counts word and punctuation pieces with a JVM regex (``regexp_count``, no array
is built), which keeps the count inside whole-stage codegen.  ``arrow_tokenizer``
wraps a Python encoder (for example a BPE encoder) as an Arrow-batched pandas UDF
for exact vendor counts.

Constant strings (role names, catalog system prompts) are tokenized once on a
tiny table and enter the per-row arithmetic as literals.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gradebook import fixed
from gradebook.functions.text import col_

# Word runs (letters, digits, underscore) or single non-space symbols.
PIECE_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

Tokenizer = Callable[[Column], Column]


_MARK = "\u0001"


def regex_tokens(text: Column | str) -> Column:
    """Default tokenizer: number of word/punctuation pieces (0 for null).

    Each piece is replaced by one marker character and the markers are counted
    (one regex pass, no array of matched strings).  Every character outside ASCII
    whitespace belongs to some piece, so marker count = piece count even when the
    text itself contains the marker.
    """
    marked = F.regexp_replace(col_(text), PIECE_PATTERN, _MARK)
    n = F.length(marked) - F.length(F.replace(marked, F.lit(_MARK), F.lit("")))
    return F.coalesce(n, F.lit(0)).cast("long")


def arrow_tokenizer(encode: Callable[[str], list]) -> Tokenizer:
    """Wrap ``encode(text) -> tokens`` as a vectorised pandas UDF tokenizer."""

    @F.pandas_udf("long")
    def _count(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: len(encode(t))).astype("int64")

    return lambda c: _count(col_(c))


def constant_counts(spark: SparkSession, texts: Mapping[str, str], tokenizer: Tokenizer = regex_tokens) -> dict[str, int]:
    """Token counts of a small set of constant strings, computed with ``tokenizer``."""
    if not texts:
        return {}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    return {r["k"]: int(r["n"]) for r in df.select("k", tokenizer(F.col("t")).alias("n")).collect()}


def message_overheads(judge_model: str) -> tuple[int, int]:
    """(tokens per message, tokens per name) for a judge model name."""
    if judge_model == "gpt-3.5-turbo-0301":
        return fixed.TOKENS_PER_MESSAGE_LEGACY, fixed.TOKENS_PER_NAME_LEGACY
    if "gpt-3.5-turbo" in judge_model or "gpt-4" in judge_model:
        return fixed.TOKENS_PER_MESSAGE, fixed.TOKENS_PER_NAME
    raise NotImplementedError(f"token accounting is not defined for model {judge_model!r}")


def message_tokens(
    messages: list[tuple[str | Column | int, Column | str | int]],
    judge_model: str = "gpt-3.5-turbo",
    tokenizer: Tokenizer = regex_tokens,
) -> Column:
    """T1 for a fixed-shape message list of (role, content) pairs.

    sum(per-message overhead + tokens(role) + tokens(content)) + reply priming.
    An ``int`` role or content is an already known token count.
    """
    per_message, _ = message_overheads(judge_model)

    def count(x) -> Column:
        if isinstance(x, int):
            return F.lit(x).cast("long")
        return tokenizer(F.lit(x) if isinstance(x, str) else x)

    total = F.lit(fixed.REPLY_PRIMING_TOKENS).cast("long")
    for role, content in messages:
        total = total + F.lit(per_message) + count(role) + count(content)
    return total


def dialog_tokens(dialog: Column | str, judge_model: str = "gpt-3.5-turbo", with_name: bool = False) -> Column:
    """T1 over an ``array<struct<role,content[,name]>>`` column with the regex tokenizer.

    With ``with_name`` a non-null ``name`` field adds its tokens plus the
    per-name adjustment.  Higher-order functions keep the sum inside the JVM.
    """
    per_message, per_name = message_overheads(judge_model)
    d = col_(dialog)

    def one(m: Column) -> Column:
        t = F.lit(per_message) + regex_tokens(m["role"]) + regex_tokens(m["content"])
        if with_name:
            t = t + F.when(m["name"].isNotNull(), regex_tokens(m["name"]) + F.lit(per_name)).otherwise(F.lit(0))
        return t

    pieces = F.transform(d, one)
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: acc + x) + F.lit(fixed.REPLY_PRIMING_TOKENS)
