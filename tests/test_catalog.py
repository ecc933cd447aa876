import pytest
from conftest import SF
from oracle import compare

from tessera.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        compare(df, catalog.SQL[name], SF)
    else:
        assert df.count() > 0
