import pytest

from quire.llm import registry
from tests.compare import both


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = both(registry.QUERIES[name], registry.ORACLES[name], spark, "/root/testdata/sf0.001")
    assert got == want
