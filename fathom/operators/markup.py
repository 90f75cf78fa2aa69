"""Markup as a flat list of tokens with partners; no tree is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

START, END, TEXT, OTHER = "start", "end", "text", "other"

_INSIDE = r"""(?:[^>"'=]+|=\s*+(?:"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+'|[^\s>"'][^\s>]*+)?|"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+')*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<{_INSIDE}>|[^<]+", re.S | re.I)
_SCRIPT_END = re.compile(r"</script(?=[\s/>]|\Z)", re.I)
_LABEL = re.compile(r"</?\s*([^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=>"'/][^\s=>]*)(?:\s*=\s*("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s>]*))?""", re.S)
_FRAMES = ("iframe", "noscript")


@dataclass(slots=True)
class Token:
    kind: str
    first: int
    last: int
    label: str = ""
    #: Index of the partner: of a start tag its end tag; of an unclosed one, found while searching, the next of its name; its own for text and single tags.
    partner: int | None = None
    #: Where the end tag begins and how long it is; None: not known.
    end: int | None = None
    end_size: int = 0


def tokenize(text: str) -> list[Token]:
    """Tokens of HTML or XML in order; comments are left out. End tags have partners, unclosed p, tr, td and table their extent."""
    tokens: list[Token] = []
    at, size, xml, in_script = 0, len(text), False, False
    while at < size:
        if in_script:
            m = _SCRIPT_END.search(text, at)
            stop = m.start() if m else size
            if stop > at:
                tokens.append(Token(TEXT, at, stop))
            at, in_script = stop, False
            continue
        m = _TOKEN.match(text, at)
        if m is None:  # a tag that never ends
            tokens.append(Token(TEXT, at, size))
            break
        stop, piece = m.end(), m[0]
        if piece[0] != "<" or piece[:9].upper() == "<![CDATA[":
            tokens.append(Token(TEXT, at, stop))
        elif piece.startswith("<!--"):
            pass
        elif piece[:2] in ("<!", "<?"):
            xml |= piece[:5].lower() == "<?xml"
            tokens.append(Token(OTHER, at, stop))
        elif piece[:2] == "</":
            tokens.append(Token(END, at, stop, _LABEL.match(piece)[1].lower()))
        else:
            t = Token(START, at, stop, _LABEL.match(piece)[1].lower())
            if piece.endswith("/>") and not re.search(r"=\s*[^\s\"'>]+/>\Z", piece):
                t.end, t.partner = stop, len(tokens)
            elif t.label == "script":
                in_script = True
            tokens.append(t)
        at = stop
    _pair(tokens)
    if not xml:
        _close(tokens, size)
    return tokens


def _pair(tokens: list[Token]) -> None:
    """Each end tag goes with the nearest start tag of its name before it that has none yet; pairs may cross."""
    open_by: dict[str, list[int]] = {}
    for k, t in enumerate(tokens):
        if t.kind == START and t.partner is None:
            open_by.setdefault(t.label, []).append(k)
        elif t.kind == TEXT:
            t.partner = k
        elif t.kind == END:
            if t.label:
                stack = open_by.get(t.label)
            else:  # </> closes any
                stack = max((s for s in open_by.values() if s), key=lambda s: s[-1], default=None)
            if stack:
                s = tokens[j := stack.pop()]
                s.partner, s.end, s.end_size, t.partner = k, t.first, t.last - t.first, j


def _close(tokens: list[Token], size: int) -> None:
    last = size
    for t in reversed(tokens):
        if t.kind == START and t.label == "p" and t.end is None:
            t.end, last = last, t.first
    for inner, outer in (("tr", "table"), ("td", "tr"), ("table", "td")):
        for k in range(len(tokens) - 1, -1, -1):
            o = tokens[k]
            if o.kind == START and o.label == outer and o.end is not None:
                for t in tokens[k + 1 :]:
                    if t.first >= o.end:
                        break
                    if t.kind == START and t.label == inner and t.end is None:
                        t.end = o.end


def delimited(text: str, start: str, end: str | None, sensitive: bool) -> list[Token]:
    """Tokens of plain delimiters: a start goes with the next end; with no end given, only starts are marked."""
    if not start:
        return []
    flags = re.S if sensitive else re.S | re.I
    find = re.compile(re.escape(start), flags)
    if end is None:
        return [Token(START, m.start(), m.end(), start) for m in find.finditer(text)]
    both = re.compile(f"({re.escape(start)})|({re.escape(end)})" if end != start else f"({re.escape(start)})", flags)
    out: list[Token] = []
    waiting: Token | None = None
    for m in both.finditer(text):
        if waiting is not None and (end == start or m.lastindex == 2):
            waiting.end, waiting.end_size = m.start(), m.end() - m.start()
            waiting.partner = len(out) + 1
            out += [waiting, Token(END, m.start(), m.end())]
            waiting = None
        elif waiting is None and m.lastindex == 1:
            waiting = Token(START, m.start(), m.end(), start)
    return out


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag by name in lower case with : and - as _; one without a value has its name as value."""
    label = _LABEL.match(tag)
    inside = tag[label.end() if label else 0 : -1 if tag.endswith(">") else None]
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(inside.removesuffix("/") if not re.search(r"=\s*[^\s\"']+/\Z", inside) else inside):
        name, value = m[1], m[2]
        if value is None:
            value = name
        elif value[:1] in "\"'" and value[:1]:
            value = value[1:-1]
        out.setdefault(re.sub("[:-]", "_", name).lower(), value)
    return out


def search(tokens: list[Token], at: int, label: str, wild: bool, outermost: bool, no_embed: bool, last_label: str | None, no_frames: bool) -> int | None:
    """Index of the next start tag after token ``at`` (-1: from the start); see the options of the language."""
    wanted = lambda t: t.kind == START and (wild or t.label == label)
    k = at + 1
    if outermost and at >= 0 and (p := tokens[at].partner) is not None and p != at and wanted(tokens[at]):
        k = p
    while k < len(tokens) and not wanted(tokens[k]):
        t = tokens[k]
        inner = t.kind == START and t.partner is not None and t.partner != k
        skipped = inner and (no_embed and t.label == last_label or no_frames and t.label in _FRAMES or not outermost and t.label == "script")
        k = t.partner + 1 if skipped and t.partner > k else k + 1
    if k >= len(tokens):
        return None
    if outermost and tokens[k].partner is None:
        for j in range(k + 1, len(tokens)):
            if wanted(tokens[j]):
                tokens[k].partner = j
                break
            if no_embed and tokens[j].kind == START and tokens[j].label == last_label:
                break
    return k
