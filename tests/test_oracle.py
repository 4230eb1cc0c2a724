"""Every registered query against its DuckDB twin (sf0.001: fast), plus the
contract of __spark_entry__."""

import pytest

from tools.check_oracle import compare

import __spark_entry__ as E
from ticketlab.plans import catalog

NAMES = sorted(E.queries())


def test_every_query_has_a_twin_or_is_rows_only():
    sql = E.oracle_sql()
    assert set(sql) <= set(E.queries())
    # the optional training-data operators have their own tests
    assert set(catalog.QUERIES) <= set(sql)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_tickets > 0
    assert df.columns == ["total_tickets", "active_accounts", "product_areas", "avg_csat", "escalation_rate"]


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, "/root/testdata/sf0.001", verbose=False)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(results, name):
    assert results[name].startswith("ok") or results[name].startswith("rows-only"), results[name]
