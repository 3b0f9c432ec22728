"""Every registered query of the governance operators against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from govlake.plans import registry

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    oracle.same(registry.QUERIES[name](spark, SF), duck, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
