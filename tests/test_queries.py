"""Every registered query of the engine against DuckDB, on the smallest tables."""

import pytest
from oracle import SMALL, check, connect

from fieldnotes import plans


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert plans.queries().keys() == plans.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    check(con, plans.queries()[name](spark, SMALL), plans.oracle_sql()[name])
