import pytest


@pytest.fixture
def docs_of(spark):
    """Documents with columns whose names clash with those that operators use."""

    def make(texts, ids=None, **extra):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", 7, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, n int, score string")

    return make
