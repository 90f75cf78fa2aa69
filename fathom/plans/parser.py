"""The query language: text to steps."""

from __future__ import annotations

import re

from fathom.plans.expressions import Parser as ExpressionParser
from fathom.plans.expressions import SyntaxProblem, unquoted
from fathom.plans.nodes import Complement, Function, Group, Range, Reduce, Schema, Source, Tag

#: Options of a tag: to which flag and value each leads. INCL and EXCL are for the kind of tag they stand in.
OPTIONS = {
    "SEN": ("sensitive", True), "INSEN": ("sensitive", False), "INCL": ("inclusive", True), "EXCL": ("inclusive", False),
    "IRAN": ("range_first", True), "ORAN": ("range_first", False), "RECUR": ("outermost", True), "NORECUR": ("outermost", False),
    "SEP": ("separates", True), "EMBED": ("no_embed", False), "NOEMBED": ("no_embed", True), "IFRAME": ("no_frames", False),
    "NOIFRAME": ("no_frames", True), "MATCH": ("match", True),
}

_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"[^\W\d][\w:.-]*")
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*\"""", re.S)
_PLAIN = re.compile(r"[^\s/~>({]+")
_ATTRIBUTE = re.compile(r"[^\W\d][\w:-]*")


def special(text: str) -> str:
    """Escapes of a plain tag: \\t \\n \\r, octal, and any other character as itself."""
    return re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8)) if m[1].isdigit() else {"t": "\t", "n": "\n", "r": "\r"}.get(m[1], m[1]), text, flags=re.S)


class Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def space(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self) -> str:
        self.space()
        return self.text[self.at : self.at + 1]

    def take(self, what: str) -> bool:
        self.space()
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise SyntaxProblem(f"{what!r} is missing at {self.at} in {self.text!r}")

    def match(self, pattern: re.Pattern) -> str | None:
        self.space()
        m = pattern.match(self.text, self.at)
        if m is None:
            return None
        self.at = m.end()
        return m[0]

    def expression(self):
        p = ExpressionParser(self.text, self.at)
        found = p.expression()
        self.at = p.start
        return found

    def steps(self, ends: str = "") -> tuple:
        """Steps up to one of the characters in ``ends``, which is left."""
        out: list = []
        fresh = True  # at the start or after a dot a slash opens a plain tag, elsewhere a reduction
        while (c := self.peek()) and c not in ends:
            if c == ".":
                self.at += 1
                fresh = True
                continue
            gaps = False
            if c == "-" and not (out and not fresh):
                self.at += 1
                gaps, c = True, self.peek()
            step = self.step(c, fresh)
            out.append(Complement(step) if gaps else step)
            fresh = False
        return tuple(out)

    def step(self, c: str, fresh: bool):
        if c == "<":
            return self.hyper()
        if c == "/" and fresh:
            return self.plain()
        if c in "/*":
            return self.reduction()
        if c == ":":
            return Tag("last", attributes=self.attributes())
        if c == "{":
            return self.schema()
        if c == "&":
            return self.function()
        if c == "(":
            self.at += 1
            inner = Group(self.steps(")"))
            self.need(")")
            return inner
        if c in "'\"":
            return Source(unquoted(self.match(_QUOTED)))
        if self.match(re.compile(r"(?=[^\W\d])")) is not None:
            return Tag("last", attributes=self.names())
        raise SyntaxProblem(f"no step begins with {c!r} at {self.at} in {self.text!r}")

    def hyper(self) -> Tag:
        self.need("<")
        gaps, wild = self.take("-"), None
        if self.peek() in ("*", "@"):
            wild = self.text[self.at]
            self.at += 1
        if self.text[self.at : self.at + 1] in "'\"" and self.text[self.at : self.at + 1]:
            name = unquoted(self.match(_QUOTED))
        elif wild and self.text[self.at : self.at + 1] in (" ", ">", "\t", "\n", "("):
            name = wild
        else:
            name = self.match(_WORD)
        if name is None:
            raise SyntaxProblem(f"a tag's name is missing at {self.at} in {self.text!r}")
        options, conditions = self.filters(">")
        return Tag("hyper", name, None, wild, gaps, options, conditions, self.ranges(), self.attributes())

    def plain(self) -> Tag:
        self.need("/")
        gaps, wild = self.take("-"), None
        if self.peek() in ("*", "@"):
            wild = self.text[self.at]
            self.at += 1
        if self.peek() in ("'", '"'):
            name = special(self.match(_QUOTED)[1:-1])
        elif self.peek() == "/" and wild:
            name = wild
        else:
            begin = self.at
            m = re.compile(r"[A-Za-z_]\w*\s*\(").match(self.text, self.at)
            if m:  # a call, as chr(10)
                call = ExpressionParser(self.text, self.at)
                name, self.at = call.operand(), call.start
                from fathom.operators.evaluate import text_of, value

                name = text_of(value(name, {}))
            else:
                name = self.match(_PLAIN)
            if name is None:
                raise SyntaxProblem(f"a delimiter is missing at {begin} in {self.text!r}")
            name = special(name)
        end, separates = None, ("separates", True)
        if self.take("~"):
            separates = ("separates", False)
            end = special(self.match(_QUOTED)[1:-1]) if self.peek() in ("'", '"') else ""
        options, conditions = self.filters("/")
        return Tag("plain", name, end, wild, gaps, (separates, *options), conditions, self.ranges(), self.attributes())

    def filters(self, end: str) -> tuple[tuple, tuple]:
        options, conditions = [], []
        while (c := self.peek()) and c != end:
            if c == "(":
                self.at += 1
                conditions.append(self.expression())
                self.need(")")
            elif c in "'\"":
                self.match(_QUOTED)  # a mapping: read, never applied
            elif (word := self.match(_WORD)) is not None:
                if word.upper() not in OPTIONS:
                    raise SyntaxProblem(f"{word!r} isn't an option, in {self.text!r}")
                options.append(OPTIONS[word.upper()])
            else:
                self.at += 1
        self.need(end)
        return tuple(options), tuple(conditions)

    def position(self) -> int:
        if self.take("("):
            from fathom.operators.evaluate import number, value

            n = int(number(value(self.expression(), {})) or 0)
            self.need(")")
            return n
        found = self.match(re.compile(r"\d+"))
        if found is None:
            raise SyntaxProblem(f"a position is missing at {self.at} in {self.text!r}")
        return int(found)

    def ranges(self) -> tuple[Range, ...]:
        out = []
        while self.peek() == "(" or self.peek().isdigit():
            first = last = self.position()
            per = 1
            if self.take("-"):
                last = self.position()
            if self.take("#"):
                per = self.position()
            out.append(Range(first, last, per))
            if not self.take(","):
                break
        return tuple(out)

    def attributes(self) -> tuple[str, ...]:
        return self.names() if self.take(":") else ()

    def names(self) -> tuple[str, ...]:
        out = []
        while (word := self.match(_ATTRIBUTE)) is not None:
            out.append(re.sub("[:-]", "_", word))
            if not self.take(","):
                break
        return tuple(out)

    def function(self) -> Function:
        self.need("&")
        name = self.match(re.compile(r"[^\W\d]\w*"))
        if name is None:
            raise SyntaxProblem(f"a function's name is missing at {self.at} in {self.text!r}")
        args = []
        if self.text[self.at : self.at + 1] == "(":
            self.at += 1
            while not self.take(")"):
                args.append(self.expression())
                if not self.take(",") and self.peek() != ")":
                    raise SyntaxProblem(f"',' or ')' is missing at {self.at} in {self.text!r}")
        return Function(name.lower(), tuple(args))

    def reduction(self) -> Reduce:
        depth = 0
        while self.take("*"):
            depth += 1
        self.need("/")
        end = self.text.find("/", self.at)
        quoted = _QUOTED.match(self.text, self.at)
        if quoted and self.text[quoted.end() : quoted.end() + 1] == "/":
            self.at = quoted.end() + 1
            return Reduce(special(quoted[0][1:-1]), depth)
        if end < 0:
            raise SyntaxProblem(f"'/' is missing at {self.at} in {self.text!r}")
        separator, self.at = self.text[self.at : end], end + 1
        return Reduce(special(separator), depth)

    def schema(self) -> Schema:
        self.need("{")
        fields, condition, outputs = [], None, []
        while self.peek() not in ("|", "}", ""):
            m = re.compile(r"\s*([^\W\d][\w:-]*)\s*=").match(self.text, self.at)
            name = ""
            if m:
                name, self.at = re.sub("[:-]", "_", m[1]), m.end()
            source = None
            if self.peek() == "%":
                source = int(self.match(re.compile(r"%\d+"))[1:])
            fields.append((name, source, self.steps(";|}")))
            self.take(";")
        if self.take("|") and self.peek() not in ("|", "}"):
            condition = self.expression()
        if self.take("|"):
            while self.peek() not in ("}", ""):
                m = re.compile(r"\s*([^\W\d]\w*)\s*=(?![=~])").match(self.text, self.at)
                name = None
                if m:
                    name, self.at = m[1], m.end()
                outputs.append((name, self.expression()))
                self.take(";")
        self.need("}")
        return Schema(tuple(fields), condition, tuple(outputs))


def parse(query: str) -> tuple:
    """The steps of a query."""
    p = Parser(query)
    steps = p.steps()
    if p.peek():
        raise SyntaxProblem(f"{p.peek()!r} at {p.at} isn't expected in {query!r}")
    return steps


def field_names(steps: tuple) -> list[str] | None:
    """Columns that steps give, as far as they name any; None: one column without a name."""
    names: list[str] | None = None
    for s in steps:
        if isinstance(s, Complement):
            s = s.step
        if isinstance(s, Tag):
            names = list(s.attributes) or None
        elif isinstance(s, Schema):
            names = [n or f"_{k + 1}" for k, (n, *_) in enumerate(s.fields)] if s.fields else names
            if s.outputs:
                first = names[0] if names else "_1"
                names = [n or (first if k == 0 else f"_{k + 1}") for k, (n, _) in enumerate(s.outputs)]
        elif isinstance(s, Reduce):
            names = names if s.depth == 2 else None
        elif isinstance(s, Group):
            names = field_names(s.steps)
        elif isinstance(s, Source):
            names = None
        elif isinstance(s, Function):
            from fathom.operators.steps import WHOLE

            if s.name in WHOLE and s.name not in KEEP_RECORDS and not (s.name == "replace" and len(s.args) > 1):
                names = None
    return names


#: Functions of the whole state that leave rows as they are but for the first field.
KEEP_RECORDS = ("url", "get_url", "url_all", "refine_null_fields", "substr")
