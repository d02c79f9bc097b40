"""Every query of the reference's operators against its SQL, on the smallest tables."""

import pytest
from helpers import SF, same

from siftyard import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, name):
    same(plans.QUERIES[name](spark, SF), plans.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert plans.QUERIES.keys() <= e.queries().keys()
    assert e.oracle_sql().keys() <= e.queries().keys()
