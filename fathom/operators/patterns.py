"""Extended regular expressions over characters, over words, or over words with tags.

Beyond the usual operators there are token atoms ``<word/TAG>`` (each part a pattern of its own),
named sets ``&[s:name]`` and word sets ``&[ws:name]``, both also given inline, negated sequences
``[^(...)]``, named groups ``(...)&[n:name]`` and conditions ``&[q:expression]``. ``\\w`` is letters
only. A match is the longest that the first place to match has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from fathom.plans.expressions import SyntaxProblem

Env = tuple  # of (group name or number, start, end)


@dataclass
class One:
    """One token: a character, or in lists any."""

    test: str  # 'any', 'char', 'class', 'atom'
    value: object = None


@dataclass
class OneOf:
    """One item of several, or, negated, a token where none of them begins."""

    items: list
    negated: bool = False


@dataclass
class NotRun:
    """A run of any tokens that as a whole isn't the inner pattern."""

    inner: object


@dataclass
class Sequence_:
    items: list


@dataclass
class Either:
    items: list


@dataclass
class Repeat:
    item: object
    least: int
    most: int | None


@dataclass
class Capture:
    item: object
    number: int
    name: str | None = None


@dataclass
class Set:
    name: str
    words: bool


@dataclass
class Anchor:
    kind: str


@dataclass
class Condition:
    text: str


@dataclass
class Parsed:
    node: object
    groups: int
    inline: dict = field(default_factory=dict)


_CLASSES = {"w": str.isalpha, "W": lambda c: not c.isalpha(), "d": str.isdigit, "D": lambda c: not c.isdigit(), "s": str.isspace, "S": lambda c: not c.isspace()}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.groups, self.inline = text, 0, 0, {}

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def either(self, ends: str) -> object:
        items = [self.sequence(ends + "|")]
        while self.peek() == "|":
            self.at += 1
            items.append(self.sequence(ends + "|"))
        return items[0] if len(items) == 1 else Either(items)

    def sequence(self, ends: str) -> Sequence_:
        out: list = []
        while (c := self.peek()) and c not in ends:
            item = self.item()
            if isinstance(item, str):  # a name for the group before
                if not out or not isinstance(out[-1], Capture):
                    raise SyntaxProblem(f"&[n:{item}] follows no group in {self.text!r}")
                out[-1].name = item
            else:
                out.append(self.repeated(item))
        return Sequence_(out)

    def repeated(self, item: object) -> object:
        c = self.peek()
        if c in ("*", "+", "?") and c:
            self.at += 1
            return Repeat(item, 1 if c == "+" else 0, 1 if c == "?" else None)
        m = re.compile(r"\{(\d+)(,?)(\d*)\}").match(self.text, self.at)
        if m:
            self.at = m.end()
            return Repeat(item, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
        return item

    def item(self) -> object:
        c = self.peek()
        if self.peek(2) == "&[":
            return self.extension()
        self.at += 1
        if c == ".":
            return One("any")
        if c in "^$":
            return Anchor(c)
        if c == "(":
            self.groups += 1
            number = self.groups
            inner = self.either(")")
            self.close(")")
            return Capture(inner, number)
        if c == "[":
            return self.set_()
        if c == "<":
            return self.atom()
        if c == "\\":
            return self.escape()
        return One("char", c)

    def close(self, what: str) -> None:
        if self.peek() != what:
            raise SyntaxProblem(f"{what!r} is missing at {self.at} in {self.text!r}")
        self.at += 1

    def escape(self) -> object:
        c = self.peek()
        self.at += 1
        if c == "b":
            return Anchor("b")
        if c in _CLASSES and c:
            return One("class", c)
        return One("char", _ESCAPES.get(c, c))

    def atom(self) -> One:
        parts, depth, begin = [], 0, self.at
        while (c := self.peek()):
            if c == "\\":
                self.at += 2
                continue
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c in "/>" and depth <= 0:
                parts.append(self.text[begin : self.at])
                self.at += 1
                begin = self.at
                if c == ">":
                    return One("atom", [parse_pattern(p) for p in parts])
                continue
            self.at += 1
        raise SyntaxProblem(f"'>' is missing in {self.text!r}")

    def set_(self) -> object:
        negated = self.peek() == "^"
        self.at += negated
        if negated and self.peek() == "(":
            self.at += 1
            inner = self.either(")")
            self.close(")")
            self.close("]")
            return NotRun(inner)
        items: list = []
        while (c := self.peek()) != "]":
            if not c:
                raise SyntaxProblem(f"']' is missing in {self.text!r}")
            if self.peek(2) == "&[":
                items.append(self.extension())
                continue
            self.at += 1
            if c == "<":
                items.append(self.atom())
            elif c == "(":
                self.groups += 1
                inner = self.either(")")
                self.close(")")
                items.append(inner)
            elif c == "|" and items and not (isinstance(items[-1], One) and items[-1].test in ("char", "class")):
                continue
            else:
                one = self.escape() if c == "\\" else One("char", c)
                if isinstance(one, One) and one.test == "char" and self.peek() == "-" and self.peek(2)[1:] not in ("]", ""):
                    self.at += 1
                    top = self.peek()
                    self.at += 1
                    items.append(One("range", (one.value, top)))
                else:
                    items.append(one)
        self.at += 1
        return OneOf(items, negated)

    def extension(self) -> object:
        m = re.compile(r"&\[\s*(\w+)\s*:\s*").match(self.text, self.at)
        if not m:
            raise SyntaxProblem(f"&[kind: is expected at {self.at} in {self.text!r}")
        kind, self.at = m[1].lower(), m.end()
        depth, begin = 0, self.at
        while (c := self.peek()) and (c != "]" or depth):
            depth += (c in "([") - (c in ")]")
            self.at += 1
        body = re.sub(r"#[^\n]*", "", self.text[begin : self.at]).strip()
        self.close("]")
        if kind == "n":
            return body
        if kind == "q":
            return Condition(body)
        if kind not in ("s", "ws", "ss"):
            raise SyntaxProblem(f"&[{kind}: isn't known")
        m = re.fullmatch(r"(\w*)\s*(?:\((.*)\))?", body, re.S)
        name = m[1] or f"inline{len(self.inline)}"
        if m[2] is not None:
            self.inline[name] = tuple(x for x in m[2].split("|"))
        return Set(name, kind == "ws")


@lru_cache(500)
def parse_pattern(text: str) -> Parsed:
    r = Reader(text)
    node = r.either("")
    if r.at < len(text):
        raise SyntaxProblem(f"{r.peek()!r} at {r.at} isn't expected in {text!r}")
    return Parsed(node, r.groups, r.inline)


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    groups: tuple = ()


class Pattern:
    """A compiled pattern. sets: names to lists of texts (in lists: of patterns or, for word sets, of phrases)."""

    def __init__(self, text: str, sets: Mapping[str, Sequence[str]] | None = None, case: bool = True) -> None:
        self.text, self.case = text, case
        self.parsed = parse_pattern(text)
        self.sets = {**{k: tuple(v) for k, v in (sets or {}).items()}, **self.parsed.inline}
        self._prepared: dict = {}

    # ---- matching

    def _fold(self, s: str) -> str:
        return s if self.case else s.lower()

    def _test(self, node: One, token: object) -> bool:
        if node.test == "any":
            return True
        if node.test == "atom":
            parts = (token,) if isinstance(token, str) else tuple(token)
            return len(parts) >= len(node.value) and all(self._part(p, str(t)) for p, t in zip(node.value, parts, strict=False))
        word = token if isinstance(token, str) else token[0]
        if node.test == "class":
            return bool(word) and all(_CLASSES[node.value](c) for c in word)
        if node.test == "range":
            return any(node.value[0] <= x <= node.value[1] for x in ((word,) if self.case else (word.lower(), word.upper())))
        return self._fold(word) == self._fold(node.value)

    def _part(self, parsed: Parsed, word: str) -> bool:
        key = (id(parsed), word)
        if key not in self._prepared:
            if len(self._prepared) > 100_000:
                self._prepared.clear()
            sub = object.__new__(Pattern)
            sub.text, sub.case, sub.parsed, sub.sets, sub._prepared = "", self.case, parsed, {**self.sets, **parsed.inline}, {}
            self._prepared[key] = any(e == len(word) for e, _ in sub._ends(parsed.node, word, 0, ()))
        return self._prepared[key]

    def _ends(self, node: object, text: Sequence, at: int, env: Env) -> Iterator[tuple[int, Env]]:
        """Where matches of node from ``at`` end, longest first as far as choices go."""
        if isinstance(node, One):
            if at < len(text) and self._test(node, text[at]):
                yield at + 1, env
        elif isinstance(node, Sequence_):
            yield from self._chain(node.items, 0, text, at, env)
        elif isinstance(node, Repeat):
            yield from self._repeat(node, text, at, env)
        elif isinstance(node, Either):
            found: dict[int, Env] = {}
            for item in node.items:
                for e, v in self._ends(item, text, at, env):
                    found.setdefault(e, v)
            yield from sorted(found.items(), key=lambda x: -x[0])
        elif isinstance(node, OneOf):
            if node.negated:
                if at < len(text) and not any(True for i in node.items for _ in self._ends(i, text, at, env)):
                    yield at + 1, env
            else:
                found = {e: v for i in reversed(node.items) for e, v in self._ends(i, text, at, env)}
                yield from sorted(found.items(), key=lambda x: -x[0])
        elif isinstance(node, NotRun):
            yield from self._run(node, text, at, env, 1, 1)
        elif isinstance(node, Capture):
            for e, v in self._ends(node.item, text, at, env):
                yield e, (*v, (node.name or node.number, at, e), *(((node.number, at, e),) if node.name else ()))
        elif isinstance(node, Set):
            yield from ((e, env) for e in self._set(node, text, at))
        elif isinstance(node, Anchor):
            if node.kind == "^" and at == 0 or node.kind == "$" and at == len(text) or node.kind == "b" and self._edge(text, at):
                yield at, env
        elif isinstance(node, Condition):
            from fathom.operators.evaluate import truth, value
            from fathom.plans.expressions import parse_expression

            row = {str(n).lower(): "".join(text[a:b]) if isinstance(text, str) else " ".join(t if isinstance(t, str) else t[0] for t in text[a:b]) for n, a, b in env}
            if truth(value(parse_expression(node.text), row)):
                yield at, env

    def _edge(self, text: Sequence, at: int) -> bool:
        if not isinstance(text, str):
            return True
        word = lambda i: 0 <= i < len(text) and text[i].isalpha()
        return word(at - 1) != word(at)

    def _chain(self, items: list, k: int, text: Sequence, at: int, env: Env) -> Iterator[tuple[int, Env]]:
        if k == len(items):
            yield at, env
            return
        for e, v in self._ends(items[k], text, at, env):
            yield from self._chain(items, k + 1, text, e, v)

    def _repeat(self, node: Repeat, text: Sequence, at: int, env: Env) -> Iterator[tuple[int, Env]]:
        item, most = node.item, len(text) - at if node.most is None else node.most
        if isinstance(item, NotRun):
            yield from self._run(item, text, at, env, node.least, most)
            return
        if isinstance(item, One) or isinstance(item, OneOf) and (item.negated or all(isinstance(i, One) for i in item.items)):
            n = 0
            while n < most and at + n < len(text) and any(True for _ in self._ends(item, text, at + n, env)):
                n += 1
            yield from ((at + k, env) for k in range(n, node.least - 1, -1))
            return
        found: dict[int, Env] = {at: env} if node.least == 0 else {}
        edge, n = {at: env}, 0
        seen = {at}
        while edge and n < most:
            n += 1
            new: dict[int, Env] = {}
            for a, v in edge.items():
                for e, w in self._ends(item, text, a, v):
                    if e not in new and (e not in seen or n <= node.least):
                        new[e] = w
            seen |= new.keys()
            edge = new
            if n >= node.least:
                for e, w in new.items():
                    found.setdefault(e, w)
        yield from sorted(found.items(), key=lambda x: -x[0])

    def _run(self, node: NotRun, text: Sequence, at: int, env: Env, least: int, most: int) -> Iterator[tuple[int, Env]]:
        barred = {e for e, _ in self._ends(node.inner, text, at, env)}
        yield from ((e, env) for e in range(min(len(text), at + most), at + least - 1, -1) if e not in barred)

    def _set(self, node: Set, text: Sequence, at: int) -> list[int]:
        items = self.sets.get(node.name, ())
        key = (node.name, node.words, isinstance(text, str))
        if key not in self._prepared:
            if isinstance(text, str):
                by: dict = {}
                for i in items:
                    by.setdefault(len(i), set()).add(self._fold(i))
            elif node.words:
                by = {}
                for i in items:
                    words = tuple(self._fold(w) for w in i.split())
                    by.setdefault(len(words), set()).add(words)
            else:
                by = [parse_pattern(i) for i in items]
            self._prepared[key] = by
        by = self._prepared[key]
        if isinstance(by, list):
            return sorted({e for p in by for e, _ in self._ends(p.node, text, at, ())}, reverse=True)
        if isinstance(text, str):
            return [at + n for n in sorted(by, reverse=True) if n and at + n <= len(text) and self._fold(text[at : at + n]) in by[n]]
        word = lambda t: self._fold(t if isinstance(t, str) else t[0])
        return [at + n for n in sorted(by, reverse=True) if n and at + n <= len(text) and tuple(map(word, text[at : at + n])) in by[n]]

    # ---- searching

    def _firsts(self, node: object) -> set[str] | None:
        """Characters that a match in a text begins with; None: not known, or it may be empty."""
        if isinstance(node, One):
            c = self._fold(node.value) if node.test == "char" else None
            return None if c is None else {c, c.lower(), c.upper()} if not self.case else {c}
        if isinstance(node, Set):
            found = {self._fold(i[:1]) for i in self.sets.get(node.name, ()) if i}
            return found if self.case else {x for c in found for x in (c, c.upper())}
        if isinstance(node, Capture):
            return self._firsts(node.item)
        if isinstance(node, Repeat):
            return self._firsts(node.item) if node.least else None
        if isinstance(node, Sequence_):
            return next((self._firsts(i) for i in node.items if not isinstance(i, Anchor)), None)
        if isinstance(node, (Either, OneOf)) and not getattr(node, "negated", False):
            parts = [self._firsts(i) for i in node.items]
            return None if None in parts else set().union(*parts)
        return None

    def matches(self, text: Sequence, overlap: bool = False, limit: int | None = None) -> Iterator[Match]:
        if not self.text:
            return
        if isinstance(text, str) and "first" not in self._prepared:
            firsts = self._firsts(self.parsed.node)
            self._prepared["first"] = re.compile("[" + "".join(map(re.escape, sorted(firsts))) + "]") if firsts else None
        jump = self._prepared.get("first") if isinstance(text, str) else None
        at, n = 0, 0
        while at < len(text) and (limit is None or n < limit):
            if jump is not None:
                m = jump.search(text, at)
                if m is None:
                    return
                at = m.start()
            hit = next(self._ends(self.parsed.node, text, at, ()), None)
            if hit is None:
                at += 1
                continue
            e, env = hit
            spans = {k: (a, b) for k, a, b in env if isinstance(k, int)}
            n += 1
            yield Match(at, e, tuple(spans.get(g) for g in range(1, self.parsed.groups + 1)))
            at = at + 1 if overlap or e == at else e

    def search_text(self, text: str, overlap: bool = False, spans: bool = False, group: bool = False, limit: int | None = None) -> list:
        """Matched texts, or (start, length) with spans, or [whole, group, ...] with group."""
        return self._results(text, overlap, spans, group, limit)

    def search_list(self, tokens: Sequence, overlap: bool = False, spans: bool = False, group: bool = False, limit: int | None = None) -> list:
        """The same over a list of words, or of tuples (word, tag, ...)."""
        return self._results(list(tokens), overlap, spans, group, limit)

    def _results(self, text: Sequence, overlap: bool, spans: bool, group: bool, limit: int | None) -> list:
        cut = (lambda a, b: (a, b - a)) if spans else (lambda a, b: text[a:b])
        out = []
        for m in self.matches(text, overlap, limit):
            whole = cut(m.start, m.end)
            out.append([whole, *(cut(*g) if g else text[0:0] for g in m.groups)] if group else whole)
        return out


#: Pattern texts whose meaning is the same in Java: no choice, set, atom, group or extension, and never empty.
_PLAIN = re.compile(r"(?:\^)?(?:(?:\\[dDsS]|\\[^\w\s]|[^\\\[\](){}|*+?.^$<>&]|\.|\[\^?(?:[^\\\[\]()<>|&^]|\\[dDsS])+\])(?:[*+?]|\{\d+(?:,\d*)?\})?)+\$?")


def literal_choice(texts: Sequence[str]) -> str:
    """A pattern for any of the texts, the longest first: shared beginnings are tried once, so its cost doesn't follow their number."""
    tree: dict = {}
    for t in texts:
        at = tree
        for c in t:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(node: dict) -> str:
        rest = [re.escape(c) + written(x) for c, x in sorted(node.items()) if c]
        if not rest:
            return ""
        body = rest[0] if len(rest) == 1 and "" not in node else f"(?:{'|'.join(rest)})"
        return body + ("?" if "" in node else "")

    return written(tree)


def java_pattern(text: str, case: bool = True, sets: Mapping[str, Sequence[str]] | None = None) -> str | None:
    """The pattern for Spark's own functions, if it is in the subset where both mean the same; else None.

    Named sets of literal texts are in it, next to what is plain.
    """
    parts = re.split(r"&\[s:(\w+)\]", text)
    for k in range(1, len(parts), 2):
        items = [t if case else t.lower() for t in (sets or {}).get(parts[k], ()) if t]
        if not items or (not case and not all(map(str.isascii, items))) or max(map(len, items)) > 200:
            return None
        parts[k] = f"(?:{literal_choice(items)})"
    if not all(_PLAIN.fullmatch(p) for p in parts[::2] if p):
        return None
    if len(parts) == 1 and (re.compile(text).match("") or re.compile(text).search("")):
        return None
    return ("(?s)" if case else "(?is)") + "".join(parts)
