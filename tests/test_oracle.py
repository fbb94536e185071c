"""Every registered query of the library against its SQL."""

import pytest

import __spark_entry__ as entry
from folioscope.plans.corpus import ORACLES
from folioscope.session import drop_staged
from tests.oracle import connect, difference

NAMES = list(ORACLES)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    assert difference(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None
    drop_staged(spark)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
