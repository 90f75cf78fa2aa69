import re

from fathom.llm import exact_dedup, sharding


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_have_no_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (sharding.shard_documents(docs), sharding.assign_shards(docs, "doc_id", [1, 2, 3]), exact_dedup.find_copies(docs), exact_dedup.drop_copies(docs), exact_dedup.surviving_cells(docs, "text")):
        assert not re.search("Python|Pandas|Arrow", plan(df))


def test_assigning_shards_moves_nothing(spark, small):
    assert "Exchange" not in plan(sharding.assign_shards(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", [1, 1]))
