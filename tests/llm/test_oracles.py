import pytest

from attestor.llm import queries
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare(spark, database(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
