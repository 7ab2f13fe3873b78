"""Every core query with SQL against DuckDB, and every other one for a schema and rows."""

from __future__ import annotations

import pytest

from palimpsest import plans

from .compare import check, duck

SLOW = {  # run over fixtures in test_whole
    "katz", "eigenvector", "lcc_entry_years",
}


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, con, data, name):
    assert check(spark, con, name, plans.queries()[name], plans.oracle_sql()[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql()) - SLOW))
def test_runs(spark, data, name):
    plans.queries()[name](spark, data).write.format("noop").mode("overwrite").save()  # every column, not just a count
