import pytest
from pyspark.sql import types as T

COLUMNS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Extra columns whose names the operators might use themselves.
    T.StructField("kept", T.StringType()), T.StructField("row_no", T.StringType()), T.StructField("hash", T.StringType()),
])


@pytest.fixture
def make(spark):
    """A documents table of (doc_id, text) rows or (doc_id, text, lang) rows, with clashing extra columns."""
    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1]) if r[1] else None, "x", None, "h") for r in rows]
        df = spark.createDataFrame(full, COLUMNS)
        return df.repartition(partitions) if partitions else df
    return build


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
