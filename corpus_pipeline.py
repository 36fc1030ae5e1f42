"""From raw documents to packed training sequences, in five stages over any corpus.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept and
returns a DataFrame, which ``run`` writes as Parquet to the shared folder and reads again for the
next one.  All but the last return the columns of the documents.

Defined results: a document with a null or blank text has no language and goes in the second stage; texts of any length are
taken whole; rows of equal id and text count as one document from the fourth stage on; an empty table stays empty; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradebook.llm import language_id, line_dedup, minhash_dedup, packing, toxicity
from gradebook.llm.common import stored, table, without_space
from gradebook.llm.queries import tokenizer_path


#: A document that has this share of its bytes (white space aside) in lines that repeat, or nearly repeat, lines of one earlier document is its copy.
COPIED = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least the threshold go; the models learn from the table of labels."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = _free(docs, "_toxicity")
    return toxicity.score(docs, scorer, name=name).where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike the labelled documents of their most probable language, go."""
    rows = language_id.sample(docs)
    gate = None if rows is None else language_id.Gate(rows)
    lang, score = _free(docs, "_lang_pred"), _free(docs, "_lang_score")
    found = language_id.predict(docs, language_id.fit(rows), lang=lang, score=score, gate=gate)
    return found.where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, from ``MIN_WORDS`` words on also those that nearly do.  A document that loses all its words
    goes with them, and so does a copy of one earlier document (``COPIED``): what is left of it is the changed lines, and the next
    stage could not tell from these what they were.  Lines that many documents share cost a document those lines only."""
    rows = line_dedup.dedupe_lines(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    full = F.octet_length(without_space(F.col("row.text")))
    lost = (F.length(without_space(F.col("text"))) == 0) | (F.col("_copied_bytes") >= full * COPIED)
    rows = rows.where((F.col("_removed_lines") == 0) | ~lost)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in the training sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: No SQL: trained models and a tokenizer decide; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
