import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows, with a column whose name clashes with results."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, "x", 1.5) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")

    return make
