"""Every registered query with a SQL twin against it; the others must run."""

import pytest

from compare import differences, duck
from groundset.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, con, name):
    df, sql = registry.queries()[name](spark, SF), registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, con, sql) == ""
