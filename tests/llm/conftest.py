import pytest
from pyspark.sql import types as P

TEXTS = [
    None, "", " \t\n", "one", "One two three four", "A" * 30_000, "été Été ÉTÉ ½ 😀 naïve " * 20,
    "the quick brown fox jumps over the lazy dog " * 12, "the quick brown fox jumps over the lazy dog " * 12,
    "x" * 399, "y" * 400, "y" * 400,
]


def documents(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those used inside operators."""
    ids = list(range(len(texts))) if ids is None else ids
    kinds = P.StructType([
        P.StructField("doc_id", P.LongType()), P.StructField("text", P.StringType()), P.StructField("lang", P.StringType()),
        P.StructField("score", P.StringType()), P.StructField("n", P.LongType()), P.StructField("item", P.LongType()),
        P.StructField("id", P.StringType()),
    ])
    return spark.createDataFrame([(i, t, None, "clash", None, 3, "x") for i, t in zip(ids, texts)], kinds)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and keys."""
    return documents(spark, [*TEXTS, "one", "one"], [*range(len(TEXTS)), 3, None])


@pytest.fixture(scope="session")
def no_documents(spark):
    return documents(spark, [])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
