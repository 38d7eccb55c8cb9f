import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from mailgrain.session import build_session
    session = build_session("mailgrain-tests", master="local[8]", cores=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def rows(spark):
    """DataFrame of (id, text) from a list of texts."""
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, text string")
