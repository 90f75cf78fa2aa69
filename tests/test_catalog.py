import pytest
from helpers import rows_of, rows_of_sql

from fathom.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_those_of_sql(spark, small, duck, name):
    assert rows_of(QUERIES[name](spark, small)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_run(spark, small, name):
    df = QUERIES[name](spark, small)
    n = df.count()
    assert (n == 0) == (name == "form_controls") and len(set(df.columns)) == len(df.columns)  # the pages hold no form


def test_titles_with_plus_and_percent_keep_them(spark, tmp_path):
    """Titles of larger tables hold phone numbers."""
    import duckdb

    titles = ["+1 (469) 555-0306", "a + b", "100 %2B+", "a%20b", "é", ""]
    rows = [(k, f"http://x.example/{k}", f"<html><title>{t}</title></html>") for k, t in enumerate(titles)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    got = rows_of(QUERIES["texts_unescaped"](spark, str(tmp_path)))
    assert got == rows_of_sql(c, ORACLES["texts_unescaped"]) and len(got[1]) == len(titles)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
