import pytest

from tests.conftest import SF, table
from threadloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert table(found.collect(), found.columns) == table(wanted.fetchall(), names)
