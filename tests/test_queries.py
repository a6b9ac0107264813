import pytest

from conftest import same_rows
from schleier.queries import QUERIES, SQL, flagship


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    same_rows(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark, sf):
    assert flagship(spark, sf).count() > 0


def test_one_narrow_stage(spark, sf):
    """De-identification moves no rows and runs no Python."""
    plan = QUERIES["deidentified_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
