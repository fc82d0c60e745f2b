"""Every registered query against its oracle."""

import pytest

from lodestone.plans import queries
from tests.conftest import cells


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf, duck, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
