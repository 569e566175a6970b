import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents of texts, numbered from 0, with columns whose names clash with those that operators use inside."""

    def documents(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), "x", 1, 2.0, "y", "z") for i, t in enumerate(texts)]
        extra = ", key string, part int, score double, block string, `group` string"
        return spark.createDataFrame(rows, DOCS + extra).repartition(3)

    return documents
