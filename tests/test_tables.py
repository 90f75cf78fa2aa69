import pytest

from fathom.operators import series
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.sql import execute
from fathom.sources import tables
from fathom.streaming import pages


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("a", 1, "x"), ("b", 3, "y"), ("c", 2, "x"), (None, None, None)], "name string, n int, kind string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_select(people):
    assert rows(execute(people, "SELECT name FROM t WHERE n > 1 ORDER BY n DESC")) == [("b",), ("c",)]
    assert rows(execute(people, "select * from t where kind = 'x' order by name desc")) == [("c", 2.0, "x"), ("a", 1.0, "x")]
    assert sorted(rows(execute(people, "SELECT kind, sum(n)+1 AS s FROM t WHERE n is not null GROUP BY kind HAVING s >= 4"))) == [("x", 4.0), ("y", 4.0)]
    assert rows(execute(people, "SELECT count(name) AS n FROM t")) == [(4.0,)]
    assert rows(execute(people, "SELECT max(n, 2) AS m, min(n) AS k FROM t WHERE kind = 'x'")) == [(2.0, 1.0)]
    assert rows(execute(people, "SELECT name FROM t WHERE name like 'A' or n = 3 ORDER BY name CHAR")) == [("a",), ("b",)]


def test_changes(people):
    assert sorted(rows(execute(people, "UPDATE t SET n = n * 2, kind = 'z' WHERE name = 'a'")), key=str)[0] == ("a", 2, "z")
    assert len(rows(execute(people, "DELETE FROM t WHERE kind = 'x'"))) == 2
    assert rows(execute(people, "DELETE FROM t")) == []
    assert ("d", 7, None) in rows(execute(people, "INSERT INTO t (name, n) VALUES ('d', 7), ('e', 8)"))
    for bad in ("DROP t", "SELECT name FROM t WHERE", "UPDATE t SET zz = 1", "SELECT a b c"):
        with pytest.raises(SyntaxProblem):
            execute(people, bad)


def test_nested_selects(spark, people):
    from fathom.plans.sql import execute_over

    assert rows(execute(people, "SELECT k + 1 AS k FROM (SELECT max(n) AS k FROM (SELECT n FROM t WHERE kind = 'x') u) AS v")) == [(3.0,)]
    over = {"p": people, "q": people}
    assert rows(execute_over(over, "SELECT a.name FROM (SELECT name, n FROM p WHERE n > 1) a, q b WHERE a.name = b.name and b.kind = 'y'")) == [("b",)]
    assert rows(execute_over(over, "SELECT p.name AS k FROM p WHERE p.n = 3")) == [("b",)]
    assert rows(execute_over(over, "SELECT * FROM (SELECT name, kind FROM p WHERE n = 2) z")) == [("c", "x")]
    for bad in ("SELECT n FROM (SELECT n FROM t", "SELECT n FROM (DELETE FROM t)", "SELECT n FROM t)"):
        with pytest.raises(SyntaxProblem):
            execute(people, bad)


def test_tables_made_and_dropped(spark, people):
    from fathom.plans.sql import change

    made = change({"p": people}, "CREATE TABLE k (a char(9), b number, c integer, d date, e)")
    assert made["k"].dtypes == [("a", "string"), ("b", "double"), ("c", "bigint"), ("d", "timestamp"), ("e", "string")] and made["k"].count() == 0
    made = change(made, "INSERT INTO k (a, b) VALUES ('x', 2.5), (null, 1)")
    assert sorted(rows(made["k"]), key=str) == [("x", 2.5, None, None, None), (None, 1.0, None, None, None)]
    made = change(change(made, "UPDATE k SET c = b + 1 WHERE a = 'x'"), "DELETE FROM k WHERE a is null")
    assert rows(made["k"]) == [("x", 2.5, 3, None, None)]
    assert set(change(made, "DROP TABLE k;")) == {"p"} and set(made) == {"p", "k"}
    for bad in ("CREATE TABLE p (a)", "CREATE TABLE z", "CREATE TABLE z (a", "DROP TABLE z", "DELETE FROM z", "SELECT * FROM p"):
        with pytest.raises(SyntaxProblem):
            change(made, bad)


def test_dates_written_and_read(spark):
    """As columns and as Python values alike, with short numbers, texts between, no date and unknown tokens."""
    from fathom.functions.scalar import FUNCTIONS, text_of

    df = spark.createDataFrame([("2021/03/04 05:06:07", "4.3.2021"), ("none", "x"), (None, None)], "v string, w string")
    for pattern in ("DD.MM.YYYY", "YYYYMMDD HH24MISS", "Mon D", "MONTH dd", "Q", "Day, HH24h", ""):
        try:
            got = execute(df, f"SELECT to_char(v, '{pattern}') AS r FROM t")
        except SyntaxProblem:
            assert pattern == "Mon D"
            continue
        assert [r.r for r in got.collect()] == [FUNCTIONS["to_char"](v, pattern) for v in ("2021/03/04 05:06:07", "none", None)], pattern
    got = execute(df, "SELECT to_char(to_date(w, 'DD.MM.YYYY', '1990-01-01')) AS r FROM t")
    assert [r.r for r in got.collect()] == [text_of(FUNCTIONS["to_date"](w, "DD.MM.YYYY", "1990-01-01")) for w in ("4.3.2021", "x", None)]


def test_orders_and_unique_keys(spark, people):
    from fathom.operators.keys import insert_unique, ordered

    df = spark.createDataFrame([("bb", "10"), ("A", "9"), ("a", "x"), (None, None)], "k string, v string")
    assert [r.v for r in ordered(df, [("k", "length desc"), ("v", "integer")]).collect()] == ["10", "x", "9", None]
    assert [r.k for r in ordered(df.where("k is not null"), [("k", "ci"), ("v", "char desc")]).collect()] == ["a", "A", "bb"]
    for bad in (("k", "up"), ("zz", "desc")):
        with pytest.raises(SyntaxProblem):
            ordered(df, [bad])
    added = spark.createDataFrame([("c", "1"), ("c", "2"), ("A", "3"), (None, "4"), ("d", None)], "k string, v string").coalesce(1)
    assert sorted(rows(insert_unique(df, added, ["k"])), key=str) == sorted([*rows(df), ("c", "1"), ("d", None)], key=str)
    assert sorted(rows(insert_unique(df.limit(0), added, ["k"])), key=str) == sorted([("c", "1"), ("A", "3"), (None, "4"), ("d", None)], key=str)


def test_row_tags_are_told_from_the_text(spark, tmp_path):
    from fathom.sources.tables import guess_row_tag, read_xml

    text = "<?xml version='1.0'?>\n<!-- <z/> -->\n<book>\n<page n='1'><t>a</t></page>\n<note/><page n='>'><t>b</t></page>\n</book>"
    assert guess_row_tag(text) == "page" and guess_row_tag("<one>1</one>") == "one" and guess_row_tag("") is None
    (tmp_path / "b.xml").write_text(text)
    assert sorted(r.t for r in read_xml(spark, str(tmp_path / "b.xml")).collect()) == ["a", "b"]


def test_row_numbers(spark):
    df = spark.range(100).repartition(7)
    assert sorted(r.n for r in execute(df, "SELECT rownum AS n, id FROM t").collect()) == [float(k) for k in range(1, 101)]


def test_tables_join_by_text_keys(spark):
    """Texts that are equal, or as numbers equal, or both NULL: found by a join, not by multiplying tables out."""
    from fathom.plans.sql import execute_over

    texts = ["a", "A", "1", "1.0", "01", " 1", "-0", "0", "", None, "x y", "1e0"]
    one = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, k string")
    two = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "j int, k2 string")
    out = execute_over({"p": one, "q": two}, "SELECT i, j FROM p, q WHERE k = k2 and i >= 0")
    physical = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    cross = one.crossJoin(two)
    slow = execute(cross, "SELECT i, j FROM t WHERE not (k <> k2)")
    assert sorted(rows(out)) == sorted(rows(slow)) and (0.0, 1.0) not in rows(out) and (2.0, 3.0) in rows(out)


def test_other_columns_of_a_group_are_those_of_its_last_row(spark):
    df = spark.createDataFrame([(k % 3, k, f"v{k}" if k != 29 else None) for k in range(30)], "g int, k int, v string").coalesce(3)
    got = {r.g: (r.k, r.v, r.n) for r in execute(df, "SELECT g, k, v, count(k) AS n FROM t GROUP BY g").collect()}
    assert got == {0.0: (27.0, "v27", 10.0), 1.0: (28.0, "v28", 10.0), 2.0: (29.0, None, 10.0)}


def test_series(spark):
    df = spark.createDataFrame([("u", k, float(v)) for k, v in enumerate([1, 5, 2, 2, 9])], "u string, t int, v double")
    assert [r.moved for r in series.moving(df, ["u"], ["t"], "v", 1).orderBy("t").collect()] == [1.0, 3.0, 3.5, 2.0, 5.5]
    assert [r.moved for r in series.moving(df, ["u"], ["t"], "v", 1, 1, "median").orderBy("t").collect()] == [3.0, 2.0, 2.0, 2.0, 5.5]
    assert [r.v for r in series.peaks(df, ["u"], ["t"], "v").collect()] == [5.0]


def test_files(spark, tmp_path, people):
    tables.write_delimited(people, str(tmp_path / "d"), delimiter=";")
    back = tables.read_delimited(spark, str(tmp_path / "d"), delimiter=";")
    assert sorted(rows(back), key=str) == sorted([(a, None if b is None else str(b), c) for a, b, c in rows(people)], key=str)
    assert tables.without_empty_rows(back).count() == 3
    tables.write_xml(people.dropna(), str(tmp_path / "x"), "person", "people")
    assert tables.read_xml(spark, str(tmp_path / "x"), "person").count() == 3
    assert tables.guess_delimiter("a\tb\n1\t2\n") == "\t"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.html").write_text("<a>1</a>\n<a>2</a>")
    assert tables.read_pages(spark, str(tmp_path / "p")).first().html == "<a>1</a>\n<a>2</a>"


def _drain(stream, mode, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("u", "<a>1</a>"), ("u", "<a>2</a>"), ("v", None)], "url string, html string").coalesce(1).write.mode("overwrite").parquet(str(src / "p"))
    stream = spark.readStream.schema("url string, html string").parquet(str(src / "p"))
    _drain(pages.stream_query(stream, "<a>:tx", keep=("url",)), "append", "links_seen", tmp_path)
    assert sorted(r.tx for r in spark.table("links_seen").collect()) == ["1", "2"]
    _drain(pages.changes(stream), "append", "changes_seen", tmp_path)
    assert sorted((r.url, r.version) for r in spark.table("changes_seen").collect()) == [("u", 1), ("u", 2), ("v", 1)]
    _drain(pages.changes(stream, forget_after=None), "append", "changes_kept", tmp_path)
    assert spark.table("changes_kept").count() == 3
    assert pages.differing("<a>1</a>", "<a>22</a>") == 2 and pages.differing("x", "x") == 0


def test_windows_on_a_stream(spark, small, tmp_path):
    spark.read.parquet(f"{small}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "e")).schema).parquet(str(tmp_path / "e"))
    _drain(pages.windowed_counts(stream), "complete", "counts_seen", tmp_path)
    assert spark.table("counts_seen").groupBy().sum("n").first()[0] == 1000


def test_fetch_with_a_transport(spark):
    from fathom.sources.requests import fetch

    df = spark.createDataFrame([("http://a",), (None,)], "url string")
    assert sorted(rows(fetch(df, lambda u: f"<p>{u}</p>")), key=str) == [("http://a", "<p>http://a</p>"), (None, None)]
