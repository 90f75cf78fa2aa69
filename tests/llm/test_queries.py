import pytest
from helpers import rows_of, rows_of_sql

from fathom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, small, duck, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, small, name):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    rows = QUERIES[name](spark, small).count()
    assert rows == n if name in ("op1_toxicity", "op2_mixing", "op8_token_counts") else rows > 0
