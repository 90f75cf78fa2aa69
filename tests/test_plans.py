"""Plans stay the ones that scale: narrow scans, no shuffle where none is needed, no product of tables."""

import re

from fathom.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text):
    return {c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^\n]*?)>(?=\n|$|,)", text) for c in re.split(r",(?![^<]*>)", m)}


def test_queries_read_what_they_name_and_shuffle_nothing(spark, small):
    for name in ("links_href_text", "records_computed", "attribute_set"):
        text = plan(QUERIES[name](spark, small))
        assert read_columns(text) == {"page_id", "url", "html"} and "Exchange" not in text and text.count("MapInArrow") == 1
    assert read_columns(plan(QUERIES["sentences"](spark, small))) == {"doc_id", "text"}


def test_conditions_of_records_are_columns(spark, small):
    text = plan(QUERIES["records_where"](spark, small))
    assert re.search(r"Filter .*octet_length", text)


def test_table_statements_stay_in_the_jvm(spark, small):
    text = plan(QUERIES["sql_group"](spark, small))
    assert "Python" not in text and "Arrow" not in text and "partial_count" in text and "GreaterThan(o_totalprice,1000.0)]" in text
    assert read_columns(text) == {"o_orderstatus", "o_totalprice"}
    assert "GreaterThan(p_size,40)" in plan(QUERIES["sql_order_typed"](spark, small))
    for name in ("sql_two_tables", "bayes_scores", "bayes_counts", "events_moving_mean"):
        text = plan(QUERIES[name](spark, small))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Arrow" not in text
    assert "ArrowEval" not in plan(QUERIES["pattern_numbers"](spark, small)) and "MapInArrow" not in plan(QUERIES["pattern_numbers"](spark, small))
