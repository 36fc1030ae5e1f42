"""Quality rules: a threshold table compiled into Spark columns, without user functions.

``RULES`` names a measure and the closed range in which a document passes.  ``measures``
computes the counts of every document in array expressions of one task (no shuffle);
``quality_rules`` adds the verdict.  Ratios are not computed but compared as products
(``count * 100 <= limit * total``), so no division by zero can occur.

Defined results: a null, empty or blank text has no words, fails the base rule and is not
kept; texts of any length are counted whole; a count at its limit passes; repeated rows give repeated results; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradebook.llm.common import without_space, words_of

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages; a text of prose holds some of them.
STOP_WORDS = {
    "en": "the be to of and that have with is in it for on as was he this by",
    "de": "der die das und ist von zu mit nicht ein eine auf für den dem im sich es",
    "fr": "le la les de des et est un une que qui dans pour sur pas du en au il",
    "es": "el la los las de y que en un una es por con para no se su del al lo",
}

#: (measure, times, of, low, high): passes when low * of <= times * measure <= high * of; None: open.
RULES = (
    ("n_words", 1, None, 50, None),
    ("word_chars", 10, "n_words", 25, 150),        # mean word length 2.5 to 15 characters
    ("n_symbols", 100, "n_words", None, 30),       # symbols per word
    ("n_stop_words", 100, "n_words", 2, None),     # share of function words
    ("n_letter_words", 100, "n_words", 60, None),  # words with a letter
    ("n_upper_words", 100, "n_words", None, 50),   # words all in capitals (two letters or more)
    ("n_dup_lines", 100, "n_lines", None, 30),     # lines that repeat an earlier one
    ("n_bullet_lines", 100, "n_lines", None, 90),
    ("n_ellipsis_lines", 100, "n_lines", None, 30),
    ("n_repeat_words", 100, "n_words", None, 50),
)


def stop_words() -> list[str]:
    return sorted({w for ws in STOP_WORDS.values() for w in ws.split()})


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts per document: id, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_stop_words, n_letter_words, n_upper_words, n_bullet_lines, n_ellipsis_lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stops = [F.lit(w) for w in stop_words()]
    base = docs.select(F.col(id_col), text.alias("_text"), words_of(F.col(text_col)).alias("_words"),
                       F.filter(F.split(text, "\n", -1), lambda x: F.length(without_space(x)) > 0).alias("_lines"))
    # Three-word windows as (hash, place), sorted: equal windows are then neighbours.  The arrays are bound
    # to lambda variables, so that a filter which the optimizer moves below still makes each of them once.
    covered = F.expr("""transform(array(_words), w -> transform(array(sort_array(transform(slice(w, 1, greatest(size(w) - 2, 0)),
            (x, i) -> struct(xxhash64(x, w[i + 1], w[i + 2]) AS h, i AS i)))), win ->
        size(array_distinct(flatten(transform(filter(win, (s, j) ->
            (j > 0 AND s.h = win[j - 1].h) OR (j < size(win) - 1 AND s.h = win[j + 1].h)),
            s -> array(s.i, s.i + 1, s.i + 2))))))[0])[0]""")
    lines, words = F.col("_lines"), F.col("_words")
    return base.select(
        F.col(id_col),
        F.size(words).cast("long").alias("n_words"),
        F.length(without_space(F.col("_text"))).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        _count(words, lambda w: F.lower(w).isin(*stops)).alias("n_stop_words"),
        _count(words, lambda w: F.lower(w) != F.upper(w)).alias("n_letter_words"),
        _count(words, lambda w: (w == F.upper(w)) & (F.lower(w) != w) & (F.length(w) > 1)).alias("n_upper_words"),
        _count(lines, lambda x: F.ltrim(x).substr(1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        _count(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean column over the counts of ``measures``."""
    passed = F.lit(True)
    for measure, times, of, low, high in rules:
        total = F.col(of) if of else F.lit(1)
        value = F.col(measure) * times
        if low is not None:
            passed = passed & (value >= total * low)
        if high is not None:
            passed = passed & (value <= total * high)
    return passed


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``measures`` with base_failed (under 50 words, or over half of them in repeated windows)
    and kept (no base failure, and every rule of the table passes)."""
    m = measures(docs, id_col, text_col)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
