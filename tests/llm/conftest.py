import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # names that operators add themselves
        T.StructField("n_words", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("hits", T.StringType()),
        T.StructField("n_lines", T.StringType()),
        T.StructField("toxic", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def odd_texts():
    """(id, text): nulls, empty, spaces only, one very long, ties and repeated rows."""
    line = "The quick brown fox of the north jumps over the lazy dog"
    long = " ".join(f"word{i % 977} and the {i}" for i in range(20_000))
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, f"{line}\n{line.upper()}  \nshort"), (5, f" {line} \nrest of it"),
        (6, line), (7, f"{line}\n\n{line}"), (8, line), (9, long), (10, long + " tail"), (11, "é ß one two 漢字 \U0001f600 done"),
        (12, "a b c a b c a b c"), (12, "a b c a b c a b c"), (None, line), (13, "x" * 5000), (14, line[:20]),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    return spark.createDataFrame([(i, t, None, "w", "k", "h", "l", "t", "s") for i, t in odd_texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
