"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest
from tests.compare import oracle, plain

from tidewheel.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), oracle(catalog.ORACLES[name], FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got).equals(plain(want))


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
