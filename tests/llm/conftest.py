import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Cases that every operator must take: nulls, empty and blank texts, one long text, repeated rows and ids.
ODD = [
    (1, None, None, None, None),
    (None, "text without an id", "en", "s", 1),
    (2, "", "en", None, 0),
    (3, " \t\n", None, "s", 3),
    (4, "word " * 40_000, "en", "s", 1),
    (5, "same words in this row twice over", "en", "s", 1),
    (5, "same words in this row twice over", "en", "s", 1),
    (6, "same words  in this row\ttwice over", "en", "t", 1),
    (7, "ÄÖ ünïcode 你好 \U0001f600 ß", "de", "t", 1),
    (8, "x", "en", "t", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd cases with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "a", "b", "key", "h", "size", "times", "digest", "keep_id", "kept", "component", "root", "part", "host", "score", "held_out", "number", "file", "sig")
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit("clash") for n in names}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
