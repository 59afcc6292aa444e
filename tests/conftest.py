import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallywork.session import local_session
    return local_session(8, "tests", memory="6g")


@pytest.fixture
def rows(spark):
    """Build a DataFrame from a DDL schema and tuples."""
    return lambda schema, *data: spark.createDataFrame(list(data), schema)
