import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import local_session

    session = local_session("tests", cores=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Evaluate Column functions over a list of input tuples."""

    def run(rows, schema, **columns):
        df = spark.createDataFrame(rows, schema)
        return df.select(*[c.alias(n) for n, c in columns.items()]).collect()

    return run
