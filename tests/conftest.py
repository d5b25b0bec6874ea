import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sluice.session import session

    s = session("tests", cpus=int(os.environ.get("TEST_CPUS", "8")), memory="6g", **{"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()
