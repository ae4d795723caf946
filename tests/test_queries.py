import pytest

from orebody.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_as_sql_says(name, same):
    same(catalog.QUERIES[name], catalog.ORACLES[name])
