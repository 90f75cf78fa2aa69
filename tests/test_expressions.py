import pytest
from hypothesis import given
from hypothesis import strategies as st

from fathom.functions.scalar import FUNCTIONS, text_of
from fathom.operators.evaluate import like, truth, value
from fathom.plans.columns import Typed, column
from fathom.plans.expressions import parse_expression

ROW = {"a": "10", "b": "9", "s": "abc", "e": "", "n": None}
CASES = [
    ("1+2*3", "7"), ("7/2", "3.5"), ("1/3", "0.333333"), ("7%4", "3"), ("-7%4", "-3"), ("2-5", "-3"), ("'a'+'b'", "ab"), ("s+&1", "abc1"), ("'x  '/&'y'", "x"), ("e/&'y'", "y"),
    ("a>9", "1"), ("a>'9'", "0"), ("a>b", "1"), ("s='abc'", "1"), ("s=='ABC'", "0"), ("s like 'A%'", "1"), ("s like '%z'", "0"), ("s is 'ABC'", "1"), ("e is null", "1"), ("n is null", "1"), ("n is not null", "0"),
    ("not (a>9)", "0"), ("a>9 and b>10", "0"), ("a>9 or b>10", "1"), ("n=n", "1"), ("n=e", "0"), ("#2020/01/02#<#2020/01/03#", "1"), ("#2020/01/03#-#2020/01/02#", "86400"),
    ("substr(s,1,1)", "b"), ("strfind(s,'c')", "2"), ("strfind(s,'z')", "-1"), ("strlen('é')", "2"), ("upper(s)", "ABC"), ("replace(s,'b','')", "ac"), ("strcat(s,1)", "abc1"), ("strcmp('a','b')", "-1"),
    ("ltrim('  x ')", "x "), ("rtrim('  x ')", "  x"), ("round(2.5)", "3"), ("floor(-1.5)", "-1"), ("ceil(1.2)", "2"), ("abs(0-3)", "3"), ("isnumber(' 7x')", "1"), ("ischar('_')", "1"), ("isblank(' ')", "1"),
    ("isphonenumber('555-123-4567')", "1"), ("html_encode('<a&b>')", "&lt;a&amp;b&gt;"), ("html_decode('&lt;&amp;lt;&copy;')", "<&lt;&copy;"), ("url_encode('a b/c')", "a+b/c"), ("get_number('x 3.5 y',1)", "3.5"),
    ("months_between(#2020/01/31#,#2021/03/01#)", "14"), ("add_months(#2020/01/31#,1)", "2020/03/02 00:00:00"), ("last_day(#2020/02/05#)", "2020/02/29 00:00:00"), ("datediff('month',#2021/03/01#,#2020/01/01#)", "14"), ("datediff('day',#2021/01/01#,#2020/01/01#)", "365"),
    ("text_words('two 字字')", "3"), ("to_number(' 12x')", "12"),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_values(text, expected):
    assert text_of(value(parse_expression(text), ROW)) == expected


def test_columns_agree_with_values(spark):
    """Every case that has a built-in form gives the same text there."""
    from pyspark.sql import functions as F

    from fathom.plans.expressions import SyntaxProblem

    df = spark.createDataFrame([tuple(ROW.values())], ", ".join(f"{k} string" for k in ROW))
    fields = {k: Typed(F.col(k), "text") for k in ROW}
    out = []
    for text, expected in CASES:
        try:
            out.append((text, expected, column(parse_expression(text), fields).text()))
        except SyntaxProblem:
            continue
    assert len(out) > 50
    got = df.select(*[c.alias(f"c{k}") for k, (*_, c) in enumerate(out)]).first()
    assert [(t, got[k]) for k, (t, e, _) in enumerate(out) if got[k] != e] == []


def test_like_takes_the_first_place():
    assert like("abcabc", "abc%") and like("xAbC", "%abc") and like("abc", "a_c") and like("abc", "a?c") and like("abc", "*c")
    assert not like("abcabc", "%abc")  # the first abc is taken, and more follows
    assert not truth("0") and truth("x") and not truth("") and not truth(None)


def test_more_functions():
    f = FUNCTIONS
    assert f["format"]("%05.2f|%-3s|%d", 3.14159, "a", "7") == "03.14|a  |7"
    assert f["to_char"]("2020/02/03 04:05:06", "YYYY-MM-DD HH24:MI:SS") == "2020-02-03 04:05:06"
    assert text_of(f["to_date"]("03.02.2020", "DD.MM.YYYY")) == "2020/02/03 00:00:00"
    assert text_of(f["next_day"]("2020/02/03", "MONDAY")) == "2020/02/10 00:00:00"
    assert f["string_comp"]("abcd", "abxd", "prefix") == "ab" and f["string_comp"]("abcd", "abxd", "align_cost") == 2
    assert f["replace"]("aXbx", "x", "-", "false") == "a-b-"


@given(st.text())
def test_decoding_undoes_encoding(s):
    assert FUNCTIONS["html_decode"](FUNCTIONS["html_encode"](s)) == s
    assert FUNCTIONS["url_decode"](FUNCTIONS["url_encode"](s.replace("+", " "))) == s.replace("+", " ") or "%" in s


@given(st.text(st.sampled_from("a1 +%2B&=/é字")) | st.text())
def test_url_decoding_gives_every_text_back(s):
    assert FUNCTIONS["url_decode"](FUNCTIONS["url_encode"](s)) == s


def test_url_encoding_of_a_plus_as_column_and_value(spark):
    texts = ["+1 (469) 555-0306", "a + b", "++", "%2B+%20", "a b", "é+字&=/"]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    s = Typed(df.s, "text")
    encoded = column(parse_expression("url_encode(s)"), {"s": s}).text()
    back = column(parse_expression("url_decode(url_encode(s))"), {"s": s}).text()
    assert [tuple(r) for r in df.select("s", encoded, back).collect()] == [(t, FUNCTIONS["url_encode"](t), t) for t in texts]
    assert FUNCTIONS["url_encode"]("a + b") == "a+%2B+b"


@given(st.text(alphabet="abc %,&<", max_size=30))
def test_split_and_join(s):
    from fathom.operators.interpret import run
    from fathom.plans.parser import parse

    assert ",".join(v for (v,) in run(s, parse("/','/")).values()) == s
