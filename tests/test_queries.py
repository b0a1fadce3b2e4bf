"""Every registered query of the core library against its SQL in DuckDB."""

import oracle
import pytest

from lumentrove.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, con, name):
    assert not oracle.differences(core.QUERIES[name](spark, SF), con, core.ORACLE_SQL[name])
