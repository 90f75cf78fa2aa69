"""Queries as texts: their steps, parts of them, and where two of them differ."""

from __future__ import annotations

import re

from fathom.plans.parser import Parser, field_names, parse


def steps(query: str) -> list[str]:
    """The texts of a query's steps, in order, each with its ranges and attributes."""
    p, out, fresh = Parser(query), [], True
    while c := p.peek():
        if c == ".":
            p.at += 1
            fresh = True
            continue
        begin = p.at
        if c == "-":
            p.at += 1
            c = p.peek()
        p.step(c, fresh)
        out.append(("." if fresh and out else "") + query[begin : p.at].strip())
        fresh = False
    return out


def count(query: str) -> int:
    return len(steps(query))


def prefix(query: str, n: int) -> str:
    """The first n steps."""
    return " ".join(steps(query)[:n])


def tail(query: str, n: int) -> str:
    """What follows the first n steps."""
    return " ".join(steps(query)[n:]).lstrip(".")


def replaced(query: str, n: int, step: str) -> str:
    """The query with its n-th step (from 1) replaced."""
    own = steps(query)
    own[n - 1] = ("." if own[n - 1].startswith(".") else "") + step
    return " ".join(own)


def with_range(query: str, n: int, range_: str) -> str:
    """The query with the range of its n-th step replaced."""
    own = steps(query)[n - 1]
    m = re.match(r"(\.?-?(?:<(?:[^>'\"]|'[^']*'|\"[^\"]*\")*>|/(?:[^/'\"]|'[^']*'|\"[^\"]*\")*/))\s*[\d,#()-]*(.*)", own, re.S)
    return replaced(query, n, (m[1] + range_ + m[2]).lstrip(".")) if m else query


def fields(query: str) -> list[str]:
    return field_names(parse(query)) or []


def differing_number(a: str, b: str) -> tuple[int, int, int] | None:
    """(step, number in a, number in b) of two queries that differ in one number only; else None."""
    x, y = steps(a), steps(b)
    differ = [k for k, (s, t) in enumerate(zip(x, y, strict=False)) if s != t]
    if len(x) != len(y) or len(differ) != 1:
        return None
    s, t = re.split(r"(\d+)", x[differ[0]]), re.split(r"(\d+)", y[differ[0]])
    places = [i for i, (p, q) in enumerate(zip(s, t, strict=False)) if p != q]
    if len(s) != len(t) or len(places) != 1 or places[0] % 2 == 0:
        return None
    return differ[0] + 1, int(s[places[0]]), int(t[places[0]])


def merged(queries: list[str]) -> str | None:
    """The one query whose range covers queries that differ in one number of the same step; else None."""
    if len(queries) < 2:
        return queries[0] if queries else None
    found = [differing_number(queries[0], q) for q in queries[1:]]
    if None in found or len({f[0] for f in found}) != 1:
        return None
    numbers = sorted({found[0][1], *(f[2] for f in found)})
    return with_range(queries[0], found[0][0], f"{numbers[0]}-{numbers[-1]}")
