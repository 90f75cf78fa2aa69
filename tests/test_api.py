from fathom import api
from fathom.operators.alignment import align_texts, consensus
from fathom.plans import rewrite

A = '<a href="/oak">10</a><a href="/elm">20</a>'


def test_cursor_and_query():
    assert api.query(A, "<a>:href,tx") == [("/oak", "10"), ("/elm", "20")] and api.query(A, "<a>:id") == [("",), ("",)]
    c = api.Cursor(A, "<a>:href,tx")
    assert len(c) == 2 and c.fields() == ["href", "tx"] and c["TX"] == "10" and c[-1] == "10"
    c.next()
    assert c["href"] == "/elm" and not c.is_end()
    c.next()
    assert c.is_end()
    c.first()
    c.previous()
    assert c.is_begin()
    c.last()
    assert c[1] == "20"
    assert list(api.Cursor(A, "<a>:tx")) == ["10", "20"] and list(c) == [("/oak", "10"), ("/elm", "20")]
    assert list(api.Cursor(A, "<a>2").then(":href")) == ["/elm"] and list(api.Cursor(A, "<a>2").then("<a>:href")) == []
    assert api.Cursor(A, "<a>:tx").rows(spans=True) == [((15, 2),), ((36, 2),)]
    v = api.Cursor(A, "<a (tx=k)>:href")
    v.set_variable("k", "20")
    assert list(v) == ["/elm"]


def test_own_functions():
    api.register("shout", lambda t, mark="!": t.upper() + mark)
    assert api.query("<b>x</b>", "<b>:tx &shout('?')") == [("X?",)] and "shout" in api.catalogue()


def test_queries_as_texts():
    q = "<div>2.<a (href like '%x')>1-3:href,tx &tx &trim"
    assert rewrite.count(q) == 4 and rewrite.steps(q)[0] == "<div>2"
    assert rewrite.prefix(q, 1) == "<div>2" and rewrite.tail(q, 2) == "&tx &trim"
    assert rewrite.with_range("<a>1:tx", 1, "4") == "<a>4:tx" and rewrite.replaced("<a> &tx", 2, "&trim") == "<a> &trim"
    assert rewrite.fields("<a>{x=:href;y=:tx}") == ["x", "y"]
    assert rewrite.differing_number("<a>1:tx", "<a>7:tx") == (1, 1, 7) and rewrite.differing_number("<a>1", "<b>1") is None
    assert rewrite.merged(["<a>1:tx", "<a>3:tx", "<a>2:tx"]) == "<a>1-3:tx"


def test_text_alignment():
    out = align_texts("one two three", "one three")
    assert out["X"] == ["one", "two", "three"] and out["Y"] == ["one", "", "three"] and out["cost"] == 1 and out["Y_index"][1] == (None, 0)
    assert consensus(["abcd", "abcd", "abxd"]) == "abcd" and consensus([]) == ""
