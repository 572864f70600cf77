"""Each query of the address engine against its SQL."""

import pytest
from oracle import compared

from lindero.plans import catalogue, reports  # noqa: F401 - reports adds its queries to the catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLES:
        assert compared(df, catalogue.ORACLES[name], SF) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
