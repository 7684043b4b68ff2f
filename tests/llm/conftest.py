import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
ODD = [None, "", " ", "\n\n", "a", "one two three", "x" * 50_000, "é" * 3000 + " ñ", "123 456", "👍 ok", "\x1c\x1f\x85\xa0 b", "<|endoftext|>", "a<|endoftext|>b  c", "!!! ???", "1" * 9000]


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts; extra columns with clashing names can be added."""

    def build(texts, first=0, **extra):
        rows = [(first + i, t, None, None, None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOC).repartition(3)
        from pyspark.sql import functions as F
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


@pytest.fixture(scope="session")
def odd():
    return ODD


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
