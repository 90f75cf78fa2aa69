import pytest

from fathom.operators.interpret import run
from fathom.operators.markup import tokenize
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.parser import field_names, parse

A = "<a href='/oak'>10</a><a href='/elm'>20</a><a href='/fir'>30</a>"
D = "<div>1<div>2</div></div><div>3</div>"
T = "<table><tr><th>h1</th><th>h2</th></tr><tr><td>1</td><td>2</td></tr></table>"


def values(source, query, **kw):
    return run(source, parse(query), **kw).values()


@pytest.mark.parametrize(
    ("source", "query", "expected"),
    [
        (A, "<a>:href,tx", [["/oak", "10"], ["/elm", "20"], ["/fir", "30"]]),
        (A, "<a>", [["<a href='/oak'>10</a>"], ["<a href='/elm'>20</a>"], ["<a href='/fir'>30</a>"]]),
        (A, "<a>2:tx", [["20"]]),
        (A, "<a>0:tx", [["30"]]),
        (A, "<a>2-0:tx", [["20"], ["30"]]),
        (A, "<a>(1+1):tx", [["20"]]),
        (A, "<a>1-0#2:tx", [["10"], ["30"]]),
        (A, "<a (tx>'10')>1:tx", [["20"]]),
        (A, "<a IRAN (tx>'10')>1:tx", []),
        (A, "<a>:tx /,/", [["10,20,30"]]),
        (A, "<a>:href,tx */-/ /;/", [["/oak-10;/elm-20;/fir-30"]]),
        (A, "<a>{u=:href; t=:tx | t='20'}", [["/elm", "20"]]),
        (A, "<a>{u=:href; t=:tx | | x=u+'#'+t}", [["/oak#10"], ["/elm#20"], ["/fir#30"]]),
        (A, "<a>{u=:href | %1 like '%ELM%'}", [["/elm"]]),
        (A, "<a>&tuple_count", [["3"]]),
        (A, "-<a>2", [["<a href='/oak'>10</a>"], ["<a href='/fir'>30</a>"]]),
        (A, "<-a>2", [["<a href='/oak'>10</a><a href='/fir'>30</a>"]]),
        (A, "<a SEP>", [[""], ["<a href='/oak'>10</a>"], ["<a href='/elm'>20</a>"], ["<a href='/fir'>30</a>"]]),
        (A, "<a EXCL>", [["10"], ["20"], ["30"]]),
        (A, "<*>1:tn", [["a"]]),
        (A, "<@tx>:tt", [["10"], ["20"], ["30"]]),
        (A, "<A>1:TX", [["10"]]),
        (D, "<div>", [["<div>1<div>2</div></div>"], ["<div>3</div>"]]),
        (D, "<div NORECUR>:tx", [["1<div>2</div>"], ["2"], ["3"]]),
        (D, "<div>.<div>:tx", [["2"]]),
        ("<p>a<p>b</p>", "<p>:tx", [["a<p>b</p>"], ["b"]]),
        ("a,b;c", "/','/", [["a"], ["b;c"]]),
        ("x[1]y[2]", "/'['~']'/", [["1"], ["2"]]),
        ("x[1]y[2]", "/'['~']' INCL/", [["[1]"], ["[2]"]]),
        ("a\tb", r"/'\t'/", [["a"], ["b"]]),
        ('<script>var t="</p>";</script><p>k</p>', "<p>:tx", [["k"]]),
        ("<option selected value=3>", "<option>:selected,value,id", [["selected", "3", None]]),
        ("<p data-id='7'>x</p>", "<p>:data-id", [["7"]]),
        ("<p><![CDATA[a<b]]></p>", "<p>:tx", [["a<b"]]),
        (T, "<td>:tx,th", [["1", "h1"], ["2", "h2"]]),
        (T, "<tr>2:th", [["1"]]),
        ("a<b>c</b>d<i>", "<b>:px,fx,xx,hx", [["a", "c", "d", "<b>c</b>d"]]),
        ("<br/>t<hr>", "<br>", [["<br/>"]]),
        (A, "'<b>k</b>' <b>:tx", [["k"]]),
        (A, "(<a>2):tx", [["20"]]),
    ],
)
def test_worked_examples(source, query, expected):
    assert values(source, query) == expected


def test_functions_on_rows():
    assert values("<b> x &lt; <i>y</i></b>", "<b>:tx &tx &trim") == [["x < y"]]
    assert values("<b>a  b</b>", "<b>&txstr") == [["a b"]]
    assert values("k=v=w", "&after('=')") == [["v=w"]]
    assert values("k=v=w", "&after('=',2)") == [["w"]]
    assert values("k", "&before('=')") == [[""]]
    assert values("banana", "&char_replace('an','o')") == [["booo"]]
    assert values("tel 12 and -3.5e2", "&get_number(2)") == [["-350"]]
    assert values("on 3 March 2021, then 2020-01-02", "&get_date(2)") == [["2020/01/02"]]
    assert values('a,"b,c",d', "&get_csvfield(',',2)") == [["b,c"]]
    assert values("write Ann Lee <ann@x.org>", "&get_email('%n:%m')") == [["Ann Lee:ann@x.org"]]
    assert values("<a href='../y?a&amp;b'>k</a>", "<a>:href &url", url="http://h.com/d/e.html") == [["http://h.com/y?a&b"]]
    assert values("<base href='http://b.org/x/'><a href=z>k</a>", "<a>:href &url", url="http://h.com/") == [["http://b.org/x/z"]]
    assert values("one 二 three", "&text_words") == [["3"]]


S = "<html><body><div id='m'><ul><li><a href=1 class=x>one</a></li><li><a href=2 class=x>two</a></li></ul></div><p>Name: <b>Ann</b></p><div><a href=3>three</a></div></body></html>"


@pytest.mark.parametrize("query", ["<a>", "<ul>.<a>", "<a>2", "<a>3:tx", "<li>", "<div>2", "<a (class='x')>{h=:href; t=:tx}", "<b>:tx"])
def test_queries_found_give_what_they_were_found_for(query):
    wanted = {r.base.at for r in run(S, parse(query.removesuffix(":tx").split("{")[0])).rows}
    found = values(S, f"{query} &find_query")[0][0].split("\n")
    give = lambda q: {r.base.at for r in run(S, parse(q)).rows}
    agree = [2 * len(give(q) & wanted) / (len(give(q)) + len(wanted)) for q in found]
    assert agree[0] == 1 and agree == sorted(agree, reverse=True) and len(set(found)) == len(found)
    assert give(values(S, f"{query} &find_query('long',1)")[0][0]) == wanted
    assert give(values(S, f"{query} &find_focus_query")[0][0]) == wanted


def test_other_queries_found():
    assert values(S, "<a> &find_query./'\n'/1") == [["<a>"]]
    assert values(S, "<ul> &tag_leaves_query") == [["<a NORECUR>1\n<a NORECUR>2"]]
    assert values(S, "<p> &plain_leaves_query") == [["<@tx>3:tt\n<@tx>4:tt"]]
    assert values(S, "<p> &key_leaves_query('name','none')") == [["{name=<@tx>4:tt}"]]
    assert values(S, "<zz> &find_query") == values("", "<a> &find_query") == [[""]]
    assert values("a b, c a b! a c", "&text_words('repeat',2)") == [["a b\na\nb\nc"]]


def test_updates_of_the_source():
    assert values(A, "<a>2 &delete") == [["<a href='/oak'>10</a><a href='/fir'>30</a>"]]
    assert values(A, "<a>1 &insert('X')")[0][0].startswith("X<a")
    assert values("<a>1</a>", "<a>&insert_after('!')") == [["<a>1</a>!"]]
    assert values("<a k=1>1</a>", "<a>&set_attribute('k','2')") == [['<a k="2">1</a>']]
    assert values("<a>1</a>", "<a>&set_attribute('k','say \"x\"')") == [["<a k='say \"x\"'>1</a>"]]
    assert values("<a k=1>1</a>", "<a>&delete_attribute('k')") == [["<a>1</a>"]]
    assert values(A, "<a>:tx &update('z')") == [[A.replace(">10<", ">z<").replace(">20<", ">z<").replace(">30<", ">z<")]]


def test_records_of_records_and_nulls():
    assert values("<ul><li>1<li>2</ul>", "<ul>{n=<li>:tx} **/,/") == [["1,2</ul>"]]
    assert values("<a><b>1</b></a><a></a>", "<a>{t=<b>:tx}") == [["1"], [None]]
    assert values("<a><b>1</b></a><a></a>", "<a>{t=<b>:tx | t is null}") == [[None]]
    assert values("", "<a>:tx") == []
    assert run(None, parse("<a>")).values() == []


def test_field_names_and_problems():
    assert field_names(parse("<a>:href,tx")) == ["href", "tx"]
    assert field_names(parse("<a>{a=:href | | x=a; a+'1'}")) == ["x", "_2"]
    assert field_names(parse("<a>:tx /,/")) is None
    for bad in ("<a", "<a>{x=:tx", "<a WRONG>", "&", "<a>}"):
        with pytest.raises(SyntaxProblem):
            parse(bad)


def test_tokens_make_up_the_source():
    for s in (A, D, T, "<p a='>'>x</p>", "a < b", "<!-- c --><x y=\"1'2\">"):
        tokens = tokenize(s)
        covered = "".join(s[t.first : t.last] for t in tokens)
        assert covered == s.replace("<!-- c -->", "")


def test_query_on_a_table(spark):
    from fathom.operators.select import query

    rows = [(1, "http://h/", A, "x"), (2, None, None, "y"), (3, None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, pos string")
    out = query(df, "<a>{u=:href; t=:tx | t>10 | n=t*2; u=upper(u)}")
    assert out.columns == ["page_id", "pos", "n", "u"]
    assert [(r.page_id, r.n, r.u) for r in out.orderBy("n").collect()] == [(1, "40", "/ELM"), (1, "60", "/FIR")]
    assert query(df.limit(0), "<a>").count() == 0
    kept = query(df, "<a>:id", nulls_as_empty=True)
    assert {r.id for r in kept.collect()} == {""}
