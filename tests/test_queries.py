import oracle
import pytest

from meshloom.plans import catalogue

SF = "/root/testdata/sf0.001"
WITH_SQL = sorted(catalogue.oracle_sql())
ROWS_ONLY = sorted(set(catalogue.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, con, name):
    assert oracle.difference(spark, con, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_repeatable(spark, name):
    run = lambda: sorted(map(str, catalogue.queries()[name](spark, SF).collect()))
    first = run()
    assert first and first == run()


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["src", "dst", "src_type", "dst_type"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
