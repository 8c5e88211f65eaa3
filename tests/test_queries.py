import os

import pytest

from lodestone import queries
from tests.oracle import assert_same, connect

SF = os.environ.get("LODESTONE_SMALL_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_twin(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), con, queries.ORACLE_SQL[name])


def test_queries_without_a_twin(spark):
    """The recall of the neighbour index, against the exact scan."""
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"ann_recall"}
    row = queries.QUERIES["ann_recall"](spark, SF).first()
    assert row["enough"] and row["n_queries"] > 0
