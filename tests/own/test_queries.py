import pytest

from quire import registry
from tests.compare import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = both(registry.QUERIES[name], registry.ORACLES[name], spark, SF)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    n = registry.QUERIES[name](spark, SF).count()
    assert n > 0 or name == "document_contents"  # the smallest table has no chaptered document


def test_stateless_chunks_are_dense(spark):
    rows = registry.QUERIES["document_chunks"](spark, SF).toPandas()
    assert (rows.groupby("id").idx.max() + 1 == rows.groupby("id").size()).all() and rows.text.str.len().max() <= 350
