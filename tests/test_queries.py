"""Every query with a statement gives the statement's rows."""

import pytest
from compare import DATA, duck, rows

from lociwave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert rows(found) == rows(duck().execute(catalog.ORACLES[name]).df())
    else:
        assert len(found)
