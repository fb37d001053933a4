import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from delaylens.session import local_session  # noqa: E402
from delaylens.sources.tables import Tables  # noqa: E402
from tests.harness import duck  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.driver.memory": "8g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)
