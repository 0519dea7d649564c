import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("kept", StringType()),  # extra columns whose names operators use themselves
        StructField("start", LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (id, text) pairs with extra columns of clashing names."""

    def make(pairs):
        rows = [(i, t, None, "s", len(t or ""), "x", 7) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS)

    return make
