"""Every query with SQL gives the same rows as that SQL; every other one gives rows."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from storelab.plans.check import connect, difference

QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    spark_rows = QUERIES[name](spark, sf_dir).toPandas()
    assert difference(spark_rows, duck.execute(ORACLES[name]).df()) is None


# Queries over categories with 100 rows; the smallest test data has none.
PER_CATEGORY = {"category_models", "train_per_category"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - PER_CATEGORY))
def test_gives_rows(spark, sf_dir, name):
    # all rows and columns, so that nothing is pruned away
    assert QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(PER_CATEGORY))
def test_needs_rows_per_category(spark, sf_dir, name):
    if sf_dir.endswith("sf0.001"):
        with pytest.raises(ValueError, match="no category has 100 rows"):
            QUERIES[name](spark, sf_dir)
    else:
        assert QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    assert contract.entry(spark).where("Category = 'all'").count() == 1


def test_no_localcheckpoint_or_cross_join():
    source = "\n".join(p.read_text() for p in Path(contract.__file__).parent.joinpath("storelab").rglob("*.py"))
    assert not re.search(r"localCheckpoint|crossJoin", source)


def test_narrow_scans(spark, sf_dir):
    """A query on one column reads no other table and no other column."""
    plan = QUERIES["category_upper"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "p_retailprice" not in plan
