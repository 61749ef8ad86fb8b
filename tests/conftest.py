import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from touchline.session import local_session

    return local_session("tests", "4")


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column on a one-row table."""

    def run(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return run
