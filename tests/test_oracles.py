import pytest

from attestor.plans import catalog
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_query_has_its_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, con, name):
    assert compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
