import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from counterfact.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """DataFrame of lines from a list of strings; the line number is the document number."""

    def make(texts, partitions=1):
        rows = [(i, 0, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, line_no int, line string").repartition(partitions)

    return make
