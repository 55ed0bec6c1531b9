import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) rows, with columns beside them whose names operators use themselves."""
    def make(rows, clashing=True):
        df = spark.createDataFrame(
            [(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS
        ).repartition(3)
        if clashing:
            for name in ("norm", "raw", "base", "added", "part", "row", "rep", "tree", "kept", "score", "length", "id", "_first"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
