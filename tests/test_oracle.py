"""Every query of the engine against DuckDB at the smallest size."""

import pytest
from oracle import compare, duck

from keelson.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert not compare(df, ORACLES[name], con)
    else:
        assert df.count() >= 0
