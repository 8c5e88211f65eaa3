import os

import pytest

from lodestone.llm import queries
from tests.oracle import assert_same, connect

SF = os.environ.get("LODESTONE_SMALL_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_twin(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL) - {"op8_best_fit_packing", "op7_benchmark_decontamination"}))
def test_one_row_per_document(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES[name](spark, SF)
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
