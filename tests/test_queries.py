"""Every registered query of the library against its SQL, on the driver's smallest tables."""

import os

import pytest
from oracle import differences, duck

from lodestream.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert differences(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0
