"""Expressions on one row of Python values."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from functools import lru_cache

from fathom.functions.scalar import as_date, looks_numeric, lookup, number, text_of
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.nodes import Binary, Call, Literal, Name, Unary


@lru_cache(1000)
def like_pattern(pattern: str) -> re.Pattern:
    """LIKE without case: % and * stand for any text, _ and ? for any character; a part is taken where it first occurs."""
    out = []
    for piece in re.split(r"([%*_?])", pattern):
        out.append(".*?" if piece in ("%", "*") and piece else "." if piece in ("_", "?") and piece else re.escape(piece))
    return re.compile("".join(out), re.I | re.S)


def like(text: str | None, pattern: str | None) -> bool:
    if text is None or pattern is None:
        return text is pattern
    at, any_before = 0, False
    for piece in re.split(r"([%*]+)", pattern):
        if piece[:1] in ("%", "*") and piece:
            any_before = True
        elif piece:
            m = like_pattern(piece).search(text, at) if any_before else like_pattern(piece).match(text, at)
            if m is None:
                return False
            at, any_before = m.end(), False
    return any_before or at == len(text)


def truth(v) -> bool:
    if v is None:
        return False
    if isinstance(v, (bool, int, float)):
        return v != 0
    if isinstance(v, dt.datetime):
        return True
    return bool(v) and v != "0"


def _is_number(node) -> bool:
    return isinstance(node, Literal) and node.kind == "number"


def _is_quoted(node) -> bool:
    return isinstance(node, Literal) and node.kind == "text"


def compare(op: str, a, b, left=None, right=None) -> bool:
    """Dates with dates; numbers if either side is one; texts as numbers if both look so and the right isn't quoted."""
    if isinstance(a, dt.datetime) or isinstance(b, dt.datetime):
        a, b = as_date(a), as_date(b)
        if a is None or b is None:
            return False
    elif isinstance(a, (int, float)) or isinstance(b, (int, float)) or _is_number(left) or _is_number(right):
        a, b = number(a), number(b)
    elif looks_numeric(a) and looks_numeric(b) and not _is_quoted(right):
        a, b = number(a), number(b)
    elif a is None or b is None:
        a, b = (a is not None, a or ""), (b is not None, b or "")
    if op in ("=", "=="):
        return a == b
    if op in ("!=", "<>"):
        return a != b
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def value(node, row: Mapping):
    """The value of an expression; row: field name in lower case, or its position as %n, to value."""
    if isinstance(node, Literal):
        return as_date(node.value) if node.kind == "date" else node.value
    if isinstance(node, Name):
        return row.get(node.name.lower())
    if isinstance(node, Unary):
        v = value(node.value, row)
        if node.op == "not":
            return not truth(v)
        if node.op == "is null":
            return v is None or v == ""
        return -number(v) if node.op == "-" else number(v)
    if isinstance(node, Call):
        fn = lookup(node.name)
        if fn is None:
            raise SyntaxProblem(f"there is no function {node.name!r}")
        return fn(*[value(a, row) for a in node.args])
    assert isinstance(node, Binary)
    op = node.op
    a = value(node.left, row)
    if op == "and":
        return truth(a) and truth(value(node.right, row))
    if op == "or":
        return truth(a) or truth(value(node.right, row))
    b = value(node.right, row)
    if op in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
        return compare(op, a, b, node.left, node.right)
    if op == "like":
        return like(text_of(a), text_of(b))
    if op == "is":
        return (text_of(a) or "").lower() == (text_of(b) or "").lower()
    if op in ("~", "~~", "=~", "~=", "=~~", "~~="):
        from fathom.operators.patterns import Pattern

        found = Pattern(text_of(b) or "", case=op in ("~~", "=~~", "~~=")).search_text(text_of(a) or "", spans=True)
        if op in ("~", "~~"):
            return (text_of(a) or "")[found[0][0] : found[0][0] + found[0][1]] if found else None
        return any(s == 0 and n == len(text_of(a) or "") for s, n in found)
    if op == "+&":
        return (text_of(a) or "") + (text_of(b) or "")
    if op == "/&":
        left = (text_of(a) or "").rstrip(" ")
        return left or text_of(b)
    if op == "+":
        if isinstance(a, dt.datetime):
            return a + dt.timedelta(seconds=number(b))
        if isinstance(a, (int, float)) and isinstance(b, (int, float)):
            return float(a + b)
        return (text_of(a) or "") + (text_of(b) or "")
    if op == "-":
        if isinstance(a, dt.datetime) and isinstance(b, dt.datetime):
            return (a - b).total_seconds()
        if isinstance(a, dt.datetime):
            return a - dt.timedelta(seconds=number(b))
        return number(a) - number(b)
    if op == "*":
        return number(a) * number(b)
    if op == "/":
        return number(a) / number(b) if number(b) else None
    if op == "%":
        d = int(number(b))
        n = int(number(a))
        return float(abs(n) % abs(d) * (1 if n >= 0 else -1)) if d else None
    raise SyntaxProblem(f"there is no operator {op!r}")
