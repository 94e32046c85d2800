import pytest

from tests.conftest import SF, table
from threadloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert table(found.collect(), found.columns) == table(wanted.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
