import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from estatelens.session import local_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        "4", shuffle_partitions=4, name="tests", spark__sql__warehouse__dir=str(warehouse)
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
