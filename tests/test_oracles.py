"""Every registered query of the engine against its SQL twin; those without one must give rows."""

import pytest

from querent.plans import registry
from tests.compare import connect, differences

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLE_SQL:
        found = differences(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
        if found and found.endswith("no rows"):  # the smallest tables may hold nothing of a kind; the next ones must
            found = differences(spark, connect(LARGER), name, registry.QUERIES[name], registry.ORACLE_SQL[name], LARGER)
        assert found is None, found
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0
