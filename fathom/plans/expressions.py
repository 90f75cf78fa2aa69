"""The expression language: lexer and precedence parser."""

from __future__ import annotations

import re

from fathom.plans.nodes import Binary, Call, Literal, Name, Unary

#: Binding power of binary operators, weakest first: fixed by the language.
LEVELS = {
    "or": 1, "and": 2,
    "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4,
    "~": 5, "~~": 5, "=~": 5, "~=": 5, "=~~": 5, "~~=": 5,
    "+": 6, "-": 7, "*": 8, "/": 8, "%": 8, "/&": 8,
    "like": 10, "is": 10, "+&": 11,
}
NOT_LEVEL = 3

_TOKEN = re.compile(
    r"""\s*(?:
    (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
  | (?P<text>'(?:[^'\\]|\\.|'')*')
  | (?P<date>\#[^#]*\#)
  | (?P<name>%\d+|[@$]?[^\W\d]\w*(?:(?:\.|->)[^\W\d]\w*)*|"[^"]*"|\[[^\]]*\])
  | (?P<op>=~~|~~=|=~|~=|~~|==|!=|<>|<=|>=|\+&|/&|[-+*/%()=<>~,!|;{}?:])
    )""",
    re.X | re.S,
)


class SyntaxProblem(ValueError):
    """The text isn't in the language."""


class Parser:
    """Reads one expression from a position; ``at`` is then where it ends."""

    def __init__(self, text: str, at: int = 0) -> None:
        self.text, self.at = text, at
        self.move()

    def move(self) -> None:
        m = _TOKEN.match(self.text, self.at)
        self.start = self.at
        if m is None:
            rest = self.text[self.at :].lstrip()
            self.kind, self.value, self.next = ("end", "", len(self.text)) if not rest else ("bad", rest[0], len(self.text))
            self.start = len(self.text) - len(rest)
            return
        self.kind = m.lastgroup
        self.value, self.start, self.next = m.group(self.kind), m.start(self.kind), m.end()

    def advance(self) -> str:
        value, self.at = self.value, self.next
        self.move()
        return value

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.value in ops

    def word(self) -> str | None:
        return self.value.lower() if self.kind == "name" and self.value[:1].isalpha() else None

    def binary(self) -> str | None:
        if self.kind == "name" and self.value[0] == "%":  # after an operand, %4 is a remainder and no field
            self.kind, self.value, self.next = "op", "%", self.start + 1
        if self.kind == "op" and self.value in LEVELS:
            return self.value
        w = self.word()
        return w if w in ("and", "or", "like", "is") else None

    def expression(self, least: int = 0):
        left = self.operand()
        while (op := self.binary()) is not None and LEVELS[op] > least:
            self.advance()
            if op == "is":
                negated = self.word() == "not"
                if negated:
                    self.advance()
                if self.word() == "null":
                    self.advance()
                    left = Unary("is null", left)
                else:
                    left = Binary("is", left, self.expression(LEVELS[op]))
                left = Unary("not", left) if negated else left
                continue
            left = Binary(op, left, self.expression(LEVELS[op]))
        return left

    def operand(self):
        if self.is_op("-", "+", "!"):
            op = self.advance()
            return Unary({"!": "not"}.get(op, op), self.expression(NOT_LEVEL if op == "!" else 9))
        w = self.word()
        if w == "not":
            self.advance()
            return Unary("not", self.expression(NOT_LEVEL))
        if self.is_op("("):
            self.advance()
            inner = self.expression()
            if not self.is_op(")"):
                raise SyntaxProblem(f"')' is missing at {self.start} in {self.text!r}")
            self.advance()
            return inner
        if self.kind == "number":
            return Literal(float(self.advance()), "number")
        if self.kind == "text":
            return Literal(unquoted(self.advance()), "text")
        if self.kind == "date":
            return Literal(self.advance()[1:-1], "date")
        if self.kind == "name":
            raw = self.advance()
            if raw[0] in '"[':
                return Name(raw[1:-1])
            if w == "sysdate":
                return Call("sysdate", ())
            if w == "null":
                return Literal(None, "text")
            if self.is_op("("):
                self.advance()
                args = []
                while not self.is_op(")"):
                    if self.is_op("*"):
                        self.advance()
                        args.append(Literal(1.0, "number"))
                    else:
                        args.append(self.expression())
                    if self.is_op(","):
                        self.advance()
                    elif not self.is_op(")"):
                        raise SyntaxProblem(f"',' or ')' is missing at {self.start} in {self.text!r}")
                self.advance()
                return Call(raw.lower(), tuple(args))
            return Name(raw.lstrip("@$"))
        raise SyntaxProblem(f"an operand is missing at {self.start} in {self.text!r}")


def unquoted(raw: str) -> str:
    """The text of a quoted literal: '' is a quote, a backslash keeps the next character, as \\n, \\r and \\t do theirs."""
    return re.sub(r"''|\\(.)", lambda m: "'" if m[0] == "''" else {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), raw[1:-1], flags=re.S)


def parse_expression(text: str):
    p = Parser(text)
    found = p.expression()
    if p.kind != "end":
        raise SyntaxProblem(f"{p.value!r} at {p.start} isn't expected in {text!r}")
    return found


def names_in(node) -> set[str]:
    """Names of the fields that an expression reads."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, Unary):
        return names_in(node.value)
    if isinstance(node, Binary):
        return names_in(node.left) | names_in(node.right)
    if isinstance(node, Call):
        return set().union(*map(names_in, node.args)) if node.args else set()
    return set()
