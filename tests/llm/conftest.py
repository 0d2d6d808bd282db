import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, fp string, url string"


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text) as a documents table with further columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "s", 0 if t is None else len(t), "x", "y", None) for i, t in rows], DOCS)

    return make
