import pytest

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "the quick brown fox jumps over the lazy dog again and again"),
    (3, None),
    (4, ""),
    (5, "word " * 3000),
    (6, "Ünïcode ß 中文 😀\t\n  spaces   and\x00nul"),
    (6, "another text under an id that repeats"),
    (7, "one more"),
    (7, "one more"),
    (None, "no id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns whose names clash with results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("bucket", F.lit(None).cast("string")).withColumn("kept", F.lit(2)).withColumn("tie", F.lit(3))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
