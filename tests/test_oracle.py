import os

import pytest

from meshwright.plans import registry
from tests.conftest import SF
from tests.sqlcheck import connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], duck)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
