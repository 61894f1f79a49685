"""The operators' queries against their SQL."""

import pytest

from storelab.llm.queries import ORACLES, QUERIES
from storelab.plans.check import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(found, connect(sf_dir).execute(ORACLES[name]).df()) is None
