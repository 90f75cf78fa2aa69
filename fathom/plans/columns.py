"""Expressions as Spark columns: what can be said with built-in functions runs in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.columns import FUNCTIONS
from fathom.functions.scalar import ALIASES
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.nodes import Binary, Call, Literal, Name, Unary

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
LEADING = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


class Typed:
    """A column and what it holds: 'text', 'number', 'date' or 'bool'; of a literal text, the text too."""

    def __init__(self, column: Column, kind: str, literal: bool = False, value: str | None = None) -> None:
        self.column, self.kind, self.literal, self.value = column, kind, literal, value

    def text(self) -> Column:
        if self.kind == "text":
            return self.column
        if self.kind == "bool":
            return F.when(self.column, "1").otherwise("0")
        if self.kind == "date":
            return F.date_format(self.column, "yyyy/MM/dd HH:mm:ss")
        return print_number(self.column)

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        if self.kind == "bool":
            return self.column.cast("double")
        if self.kind == "date":
            return F.unix_timestamp(self.column).cast("double")
        return F.coalesce(F.regexp_extract(self.column, LEADING, 1).try_cast("double"), F.lit(0.0))

    def date(self) -> Column:
        if self.kind == "date":
            return self.column
        if self.kind == "number":
            return F.timestamp_seconds(self.column)
        day = F.regexp_replace(F.regexp_extract(self.column, r"^\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2}(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2})?)?)", 1), "/", "-")
        return day.try_cast("timestamp")

    def truth(self) -> Column:
        if self.kind == "bool":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "number":
            return F.coalesce(self.column != 0, F.lit(False))
        return F.coalesce((self.text() != "") & (self.text() != "0"), F.lit(False))


def print_number(x: Column) -> Column:
    """Numbers without a fraction as integers, others with up to 6 digits, cut and not rounded."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.format_string("%.10f", x), r"^(-?\d+\.\d{6})", 1), "0+$", ""), r"\.$", "")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(cut)


def like(text: Column, pattern: str) -> Column:
    """LIKE without case; % and * for any text, _ and ? for any character."""
    import re

    body = "".join(".*?" if p in ("%", "*") and p else "." if p in ("_", "?") and p else re.escape(p) for p in re.split(r"([%*_?])", pattern))
    return F.coalesce(text.rlike(f"(?is)\\A(?:{body})\\z"), F.lit(False))


COMPARISONS: dict[str, Callable] = {
    "=": lambda x, y: x == y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<>": lambda x, y: x != y,
    "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y,
}


def compare(op: str, a: Typed, b: Typed) -> Column:
    do = COMPARISONS[op]
    if "date" in (a.kind, b.kind):
        return F.coalesce(do(a.date(), b.date()), F.lit(False))
    if "number" in (a.kind, b.kind) or "bool" in (a.kind, b.kind):
        return F.coalesce(do(a.number(), b.number()), F.lit(False))
    x, y = a.column, b.column
    if op in ("=", "=="):
        text = x.eqNullSafe(y)
    elif op in ("!=", "<>"):
        text = ~x.eqNullSafe(y)
    else:
        text = F.coalesce(do(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))), F.lit(False))
    if b.literal:
        return text
    both = F.coalesce(x.rlike(NUMERIC) & y.rlike(NUMERIC), F.lit(False))
    return F.when(both, F.coalesce(do(a.number(), b.number()), F.lit(False))).otherwise(text)


def text_key(x: Typed) -> Column:
    """Equal for texts that compare as equal: numbers by value, others as they are. NULL equals NULL alone."""
    number = F.concat(F.lit("n"), (x.number() + F.lit(0.0)).cast("string"))
    return F.coalesce(F.when(x.column.rlike(NUMERIC), number).otherwise(F.concat(F.lit("t"), x.column)), F.lit("0"))


def condition(node, fields: Mapping[str, Typed]) -> Column:
    """An expression as a filter: NULL and false both drop a row there, so comparisons stay bare and reach the scan."""
    if isinstance(node, Binary):
        if node.op == "and":
            return condition(node.left, fields) & condition(node.right, fields)
        if node.op == "or":
            return condition(node.left, fields) | condition(node.right, fields)
        if node.op in COMPARISONS:
            a, b = column(node.left, fields), column(node.right, fields)
            do = COMPARISONS[node.op]
            if "date" in (a.kind, b.kind):
                return do(a.date(), b.date())
            if {"number", "bool"} & {a.kind, b.kind}:
                return do(a.number(), b.number())
            if b.literal and isinstance(node.right, Literal) and node.right.value not in (None, "") and node.op not in ("!=", "<>", "<", "<="):
                return do(a.column, b.column)
            if node.op in ("=", "==") and a.kind == b.kind == "text" and not (a.literal or b.literal):
                return text_key(a) == text_key(b)  # a key of either side, by which tables can be joined
    return column(node, fields).truth()


def column(node, fields: Mapping[str, Typed]) -> Typed:
    """An expression over fields (name in lower case, and %n, to column). Raises SyntaxProblem for what has no built-in form."""
    if isinstance(node, Literal):
        if node.kind == "number":
            return Typed(F.lit(float(node.value)), "number", True)
        if node.kind == "date":
            return Typed(Typed(F.lit(node.value), "text").date(), "date", True)
        return Typed(F.lit(node.value).cast("string"), "text", True, node.value)
    if isinstance(node, Name):
        return fields.get(node.name.lower(), Typed(F.lit(None).cast("string"), "text"))
    if isinstance(node, Unary):
        v = column(node.value, fields)
        if node.op == "not":
            return Typed(~v.truth(), "bool")
        if node.op == "is null":
            return Typed(v.column.isNull() | (v.text() == "") if v.kind == "text" else v.column.isNull(), "bool")
        return Typed(-v.number() if node.op == "-" else v.number(), "number")
    if isinstance(node, Call):
        make = FUNCTIONS.get(ALIASES.get(node.name, node.name))
        if make is None:
            raise SyntaxProblem(f"{node.name!r} has no built-in form")
        return make(*[column(a, fields) for a in node.args])
    assert isinstance(node, Binary)
    op, a, b = node.op, column(node.left, fields), column(node.right, fields)
    if op in ("and", "or"):
        return Typed(a.truth() & b.truth() if op == "and" else a.truth() | b.truth(), "bool")
    if op in COMPARISONS:
        return Typed(compare(op, a, b), "bool")
    if op == "like":
        if not (isinstance(node.right, Literal) and node.right.kind == "text"):
            raise SyntaxProblem("LIKE with a pattern from the data has no built-in form")
        return Typed(like(a.text(), node.right.value or ""), "bool")
    if op == "is":
        return Typed(F.lower(F.coalesce(a.text(), F.lit(""))) == F.lower(F.coalesce(b.text(), F.lit(""))), "bool")
    if op == "+&":
        return Typed(F.concat(F.coalesce(a.text(), F.lit("")), F.coalesce(b.text(), F.lit(""))), "text")
    if op == "/&":
        left = F.rtrim(F.coalesce(a.text(), F.lit("")))
        return Typed(F.when(left != "", left).otherwise(b.text()), "text")
    if op == "+":
        if a.kind == "date":
            return Typed(F.timestamp_seconds(F.unix_timestamp(a.column) + b.number()), "date")
        if a.kind == "number" and b.kind == "number":
            return Typed(a.column + b.column, "number")
        return Typed(F.concat(F.coalesce(a.text(), F.lit("")), F.coalesce(b.text(), F.lit(""))), "text")
    if op == "-":
        if a.kind == "date" and b.kind == "date":
            return Typed((F.unix_timestamp(a.column) - F.unix_timestamp(b.column)).cast("double"), "number")
        if a.kind == "date":
            return Typed(F.timestamp_seconds(F.unix_timestamp(a.column) - b.number()), "date")
        return Typed(a.number() - b.number(), "number")
    if op == "*":
        return Typed(a.number() * b.number(), "number")
    if op == "/":
        return Typed(F.try_divide(a.number(), b.number()), "number")
    if op == "%":
        x, y = a.number().cast("long"), b.number().cast("long")
        return Typed(F.when(y != 0, x % F.abs(y)).cast("double"), "number")
    raise SyntaxProblem(f"{op!r} has no built-in form")
