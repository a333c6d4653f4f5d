import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def documents(spark):
    """A small table of documents from (doc_id, text) pairs, with columns whose names clash with internal ones."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, norm string, kept boolean"
        out = [(r + (None,) * 9)[:4] + (None if r[1] is None else len(r[1]), "x", 7, "y", None) for r in map(tuple, rows)]
        return spark.createDataFrame([Row(*r) for r in out], schema)

    return make
