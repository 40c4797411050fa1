"""Every registered time-series query against its SQL."""

import pytest

from tests.oracle import difference, duck
from tideframe.plans import catalogue


@pytest.fixture(scope="module")
def con(data):
    return duck(f"{data}/sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, con, data, name):
    assert difference(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], f"{data}/sf0.001") == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
