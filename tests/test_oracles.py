import pytest

from tidegauge.queries import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(name)
