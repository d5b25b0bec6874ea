"""Every log query against its independent SQL, on the small data."""

import pytest

from sluice.plans import registry
from tests.oracle_compare import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, name, registry.queries()[name], ORACLES[name], SF) is None


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and df.columns == ["id", "routing_key", "message_key", "payload"]
