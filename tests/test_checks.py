import pytest

import __spark_entry__ as entry
from checks.compare import canonical, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, sql, name):
    got, want = entry.queries()[name](spark, SMALL).toPandas(), sql.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
