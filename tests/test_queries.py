import pytest

import __spark_entry__ as entry
from riskloom.plans import registry

from .checks import same


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name], sf)
