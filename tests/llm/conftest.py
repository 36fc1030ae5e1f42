import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

LONG = "word " * 30_000
#: Nulls in every column, empty, blank and very long texts, repeated rows, equal ids, ties.
ODD = [(1, None, None, None, None), (None, None, None, None, None), (None, "a text without an id", "en", "s", 3), (2, "", "en", "s", 0),
       (3, " \n\t ", "de", None, 4), (4, LONG, "en", "s", 5), (4, LONG, "en", "s", 5), (5, "Ünï ça va? 日本語 😀 \r\n x", None, "s", 1),
       (6, "x" * 9000, "fr", "s", 2), (6, "the same id with another text", "en", "s", 2), (7, LONG, "en", "s", 5), (8, "123 456 !!!", "en", "s", 2)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def clashing_docs(spark):
    """Columns with the names that operators give to their own."""
    from pyspark.sql import functions as F
    names = ["start", "length", "_id", "_text", "_key", "shard", "slot", "score", "lang_pred", "kept", "first", "pos", "_removed", "cls", "key", "id", "text_key"]
    return spark.createDataFrame(ODD, DOC).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
