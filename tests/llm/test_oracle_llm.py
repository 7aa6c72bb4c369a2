import os

import pytest

from meshwright.llm import queries
from tests.conftest import SF
from tests.sqlcheck import connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect(SF))


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns
