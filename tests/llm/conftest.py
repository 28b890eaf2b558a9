import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def make(*rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
