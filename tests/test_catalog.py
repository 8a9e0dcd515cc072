"""Every catalogued query against its SQL, and the ones without SQL against simple facts."""

import pytest

from docketry.plans import catalog
from tests.oracle import DATA, available, compare

pytestmark = pytest.mark.skipif(not available(), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    rows = catalog.queries()[name](spark, DATA)
    assert rows.columns and rows.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["item_id", "doc_id", "at", "line_no"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
