"""Every catalogue query against the same question in SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from compare import connect, differences

SF = "/root/testdata/sf0.001"
ORACLE = driver.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, tables, name):
    assert differences(driver.queries()[name](spark, SF), tables, ORACLE[name]) is None


@pytest.mark.parametrize("name", ["partial_correlation", "theme_components", "fallback_linkage", "mmd_permutation", "pair_feature_catalogue"])
def test_queries_without_sql_give_rows(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    assert driver.entry(spark).columns == ["id_variable", "name_variable", "weight"]
    assert set(ORACLE) <= set(driver.queries())
