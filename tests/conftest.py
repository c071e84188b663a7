import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from termgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def corpus_of(spark):
    def make(*texts):
        rows = [(i, text, f'{{"n":{i}}}') for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, meta string")

    return make


@pytest.fixture
def rows_of():
    def collect(df, *columns):
        return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())

    return collect
