import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathom.operators.patterns import Pattern, java_pattern

WORDS = "the old mill by the river grinds no corn today".split()
TAGGED = [("the", "DET"), ("old", "ADJ"), ("mill", "NOUN"), ("grinds", "VERB"), ("no", "DET"), ("corn", "NOUN"), ("today", "ADV")]


@pytest.mark.parametrize(
    ("text", "pattern", "expected"),
    [
        ("mississippi", "[is]+", ["ississi", "i"]),
        ("mississippi", "i.{2}i", ["issi", "ippi"]),
        ("mississippi", "^mi", ["mi"]),
        ("mississippi", "^ss", []),
        ("mississippi", "p+i$", ["ppi"]),
        ("mississippi", "s{3}", []),
        ("mississippi", "[^is]+", ["m", "pp"]),
        ("mississippi", "(ss|pp)i", ["ssi", "ssi", "ppi"]),
        ("2031-07-19", r"\d{2,3}", ["203", "07", "19"]),
        ("2031-07-19", r"\d{3,}", ["2031"]),
        ("k9 and r2", r"\w\d", ["k9", "r2"]),
        ("tab\tand\nline", r"\s", ["\t", "\n"]),
        ("cat cot cut", "c[ao]t", ["cat", "cot"]),
        ("a.b.c", r"\.", [".", "."]),
        ("CamelCase", "c[a-z]+", ["CamelCase"]),
        ("x ok y", "x[^(bad)]*y", ["x ok y"]),
        ("xbady", "x[^(bad)]*y", []),
        ("3-3 4-5 6-6", r"(\d)&[n:a]-(\d)&[n:b]&[q:a==b]", ["3-3", "6-6"]),
    ],
)
def test_characters(text, pattern, expected):
    assert Pattern(pattern, case=False).search_text(text) == expected


@pytest.mark.parametrize(
    ("tokens", "pattern", "expected"),
    [
        (WORDS, "<the>", [["the"], ["the"]]),
        (WORDS, "<the><.*>", [["the", "old"], ["the", "river"]]),
        (WORDS, "<[a-z]{2}>", [["by"], ["no"]]),
        (WORDS, "<the><.*>{2}", [["the", "old", "mill"], ["the", "river", "grinds"]]),
        (WORDS, "[<by><no>]", [["by"], ["no"]]),
        (WORDS, "<grinds><corn>", []),
        (WORDS, "(<old>|<no>)<.*>", [["old", "mill"], ["no", "corn"]]),
        (TAGGED, "<.*/NOUN>", [[("mill", "NOUN")], [("corn", "NOUN")]]),
        (TAGGED, "<.*/DET><.*/ADJ>?<.*/NOUN>", [TAGGED[:3], TAGGED[4:6]]),
        (TAGGED, "<c.*/NOUN><.*/A.*>", [TAGGED[5:]]),
        (TAGGED, "<mill/VERB>", []),
    ],
)
def test_words_and_tags(tokens, pattern, expected):
    assert Pattern(pattern, case=False).search_list(tokens) == expected


SETS = {"trees": ["oak", "red oak", "elm", "elder"], "tools": ["saw", "axe"]}


def test_sets_of_names():
    text = "A red oak, an elm and an elder; an axe."
    assert Pattern("&[s:trees]", SETS).search_text(text) == ["red oak", "elm", "elder"]
    assert Pattern("an &[s:tools]", SETS).search_text(text) == ["an axe"]
    assert Pattern("&[s:(elm|axe)]", SETS).search_text(text) == ["elm", "axe"]
    words = "saw the red oak near an elm".split()
    assert Pattern("&[ws:trees]", SETS).search_list(words) == [["red", "oak"], ["elm"]]
    assert Pattern("<the>&[ws:trees]", SETS).search_list(words) == [["the", "red", "oak"]]
    assert Pattern("&[ws:tools]<.*>", SETS).search_list(words) == [["saw", "the"]]
    assert Pattern("&[s:trees]", {"trees": []}).search_text(text) == []


def test_places_overlaps_and_groups():
    p = Pattern(r"(\d+)-(\d+)")
    assert p.search_text("10-2 and 3-44", spans=True) == [(0, 4), (9, 4)]
    assert p.search_text("10-2 and 3-44", group=True) == [["10-2", "10", "2"], ["3-44", "3", "44"]]
    assert p.search_text("10-2 and 3-44", limit=1) == ["10-2"]
    assert Pattern("a.a").search_text("abacada", overlap=True) == ["aba", "aca", "ada"] and Pattern("a.a").search_text("abacada") == ["aba", "ada"]
    assert Pattern("<the>").search_list(WORDS, spans=True) == [(0, 1), (4, 1)]


@pytest.mark.parametrize("size", [10, 100, 500, 5000])
def test_large_name_sets(size):
    names = [f"name{i} x" for i in range(size)]
    assert Pattern("&[ws:n]<y>", {"n": names}).search_list(f"a name{size - 1} x y".split()) == [[f"name{size - 1}", "x", "y"]]


ATOM = st.sampled_from(["a", "b", ".", "[ab]", "[^a]", "[b-c]"])
PIECE = st.tuples(ATOM, st.sampled_from(["", "", "+", "*", "?", "{2}", "{1,2}", "{2,}"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECE, min_size=1, max_size=4).map("".join), st.text("abc", max_size=9))
def test_against_pythons_own_matcher(pattern, text):
    """At each place what Python's matcher finds there; empty matches aside, which have a rule of their own."""
    got = [x for x in Pattern(pattern).search_text(text, spans=True) if x[1]]
    at, want = 0, []
    while at < len(text):
        m = re.compile(pattern, re.S).match(text, at)
        if m and m.end() > at:
            want.append((at, m.end() - at))
            at = m.end()
        else:
            at += 1
    assert got == want


def test_java_subset_means_the_same():
    for p in (r"\d+", r"a.c", r"[^x]+y", r"th[a-z]+e", r"a{2,3}b"):
        assert java_pattern(p) is not None
        for t in ("aac 12 3 axc", "thexe the", "aaab xxy y", ""):
            assert Pattern(p).search_text(t) == [m.group() for m in re.finditer(p, t, re.S)]
    for p in (r"\w+", "a|b", "(a)", r"\d*", "<a>", "&[s:x]", r"\bx", "&[s:x]+", "(&[s:x])"):
        assert java_pattern(p) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab.", min_size=1, max_size=4), min_size=1, max_size=6), st.text("abc.", max_size=12), st.sampled_from(["&[s:x]", "c&[s:x]", "&[s:x][bc]", "&[s:x]&[s:x]"]), st.booleans())
def test_named_sets_in_java_mean_the_same(names, text, pattern, case):
    java = java_pattern(pattern, case, {"x": names})
    want = [m.group() for m in re.finditer(java[4 if case else 5 :], text, re.S | (0 if case else re.I))]
    assert Pattern(pattern, {"x": names}, case).search_text(text) == want


def test_named_sets_run_in_the_jvm(spark):
    from fathom.operators.match import search

    names = [f"name{k}" for k in range(3000)]
    df = spark.createDataFrame([(1, "name7 name71x NAME2999"), (2, None), (3, "")], "doc_id long, text string")
    out = search(df, "&[s:n]", sets={"n": names}, case=False)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.doc_id, r.pos, r.value) for r in out.orderBy("doc_id", "pos").collect()] == [(1, 0, "name7"), (1, 1, "name71"), (1, 2, "NAME2999")]
