import math

from hypothesis import given
from hypothesis import strategies as st

from fathom.operators.alignment import align, align_cost, closest, cluster, local_alignments, multiple_alignment
from fathom.operators.keywords import Dictionary

words = st.text(alphabet="abc", max_size=8)


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = d[i - 1][j - 1] + 1 if x == y else max(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


@given(words, words)
def test_alignment(a, b):
    cost, x, y = align(a, b)
    assert cost == len(a) + len(b) - 2 * lcs(a, b) == align_cost(a, b)
    assert len(x) == len(y) and x.replace("-", "") == a and y.replace("-", "") == b


@given(words, words)
def test_local_alignment(a, b):
    best = max((n for n in range(min(len(a), len(b)) + 1) if any(a[i : i + n] in b for i in range(len(a) - n + 1))), default=0)
    found = local_alignments(a, b)
    assert (found[0].score if found else 0) >= best


def test_closest_and_clusters():
    assert closest("abcd", ["xyz", "abce", "abcd"]) == (2, 0.0)
    assert closest("a", []) is None
    assert cluster(["aaaa", "bbbb", "aaab", "bbba"])[0] in ((0, 2), (1, 3))
    rows = multiple_alignment(["abcd", "abd", "acd"])
    assert len({len(r) for r in rows}) == 1 and [r.replace("-", "") for r in rows] == ["abcd", "abd", "acd"]


def test_dictionary():
    d = Dictionary({"new york": "city", "new": "word", "york": "place"})
    assert d.search("New York, newer york") == [("new york", "city", 0), ("york", "place", 16)]
    assert [k for k, *_ in d.search("york new", "key")] == ["new", "york"]
    assert d.search(None) == [] and d.search("") == []


def test_bayes_by_hand(spark):
    from fathom.operators.bayes import fit, from_xml

    rows = [(1, "y", "a", "1|2"), (2, "y", "a", ""), (3, "n", "b", None), (4, None, "b", "1")]
    df = spark.createDataFrame(rows, "k long, c string, f string, g string")
    model = fit(df, "c", ["f", "g"])
    again = from_xml(spark, model.to_xml())
    new = spark.createDataFrame([(1, "a", "1"), (2, "zzz", "0")], "k long, f string, g string")
    for m in (model, again):
        got = {(r.k, r.label): r.probability for r in m.predict(new, "k").collect()}
        p = {"y": math.log(2.5 / 4) + math.log(2.5 / 3) + math.log(1.5 / 3), "n": math.log(1.5 / 4) + math.log(0.5 / 2) + math.log(0.5 / 2)}
        z = sum(math.exp(v) for v in p.values())
        assert abs(got[1, "y"] - math.exp(p["y"]) / z) < 1e-9 and abs(sum(v for (k, _), v in got.items() if k == 2) - 1) < 1e-9


def test_requests_and_urls():
    from fathom.functions.urls import domain_name, host_name, path_name, protocol, resolve
    from fathom.sources.requests import form_request

    page = "<form action='/go?x=1' method=get><input name=q value='a b'><input type=submit name=s><select name=k><option></select></form>"
    assert form_request(page, "http://h.com/d/").url == "http://h.com/go?x=1&q=a+b&k="
    assert form_request(page.replace("get", "POST"), "http://h.com/", values={"q": "z"}).body == "q=z&k="
    assert form_request(page, "http://h.com/", 2) is None
    assert resolve("x", "http://h.com/a/b") == "http://h.com/a/x" and resolve("#t", "http://h.com/a?q") == "http://h.com/a?q#t"
    assert resolve("mailto:a@b", "http://h.com") == "mailto:a@b" and resolve("//k/z", "https://h") == "https://k/z"
    u = "https://u@www.h.com:8/p/q?x"
    assert (host_name(u), domain_name(u), path_name(u), protocol(u)) == ("www.h.com", "h.com", "/p/q", "https")
