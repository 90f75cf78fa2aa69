"""Steps on one document: cells that point into the source, rows of them, and what each step makes of these."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from fathom.functions.scalar import number, text_of
from fathom.operators import markup
from fathom.operators.evaluate import truth, value
from fathom.plans.expressions import SyntaxProblem, names_in
from fathom.plans.nodes import Complement, Function, Group, Range, Reduce, Schema, Source, Tag

#: Names that mean something of the tag itself; any other is an attribute.
IMPLICIT = ("tn", "tx", "ht", "st", "et", "tt", "fx", "px", "xx", "hx", "th")

DEFAULTS = {"sensitive": False, "hyper_inclusive": True, "plain_inclusive": False, "range_first": False, "outermost": True, "separates": False, "no_embed": False, "no_frames": False}


@dataclass(slots=True)
class Cell:
    """A value. ``at``: where it lies in the source (None: nowhere); ``head``, ``tail``: characters of its own tags at its ends."""

    text: str | None
    at: int | None = None
    head: int = 0
    tail: int = 0
    nested: Relation | None = None


@dataclass(slots=True)
class Row:
    base: Cell
    fields: list[Cell] | None = None

    def cells(self) -> list[Cell]:
        return self.fields if self.fields is not None else [self.base]

    def first(self) -> Cell:
        return self.fields[0] if self.fields else self.base


@dataclass(slots=True)
class Relation:
    rows: list[Row]
    names: list[str] | None = None

    def values(self) -> list[list[str | None]]:
        return [[c.text for c in r.cells()] for r in self.rows]

    def record(self, row: Row) -> dict:
        """Values by name in lower case and by position."""
        out = {f"%{k}": c.text for k, c in enumerate(row.cells(), 1)}
        for n, c in zip(self.names or (), row.cells(), strict=False):
            if n:
                out[n.lower()] = c.text
        return out


@dataclass
class State:
    source: str
    url: str | None = None
    variables: dict = field(default_factory=dict)
    options: dict = field(default_factory=lambda: dict(DEFAULTS))
    last: Tag | None = None
    relation: Relation = None
    tokens: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.relation is None:
            self.relation = Relation([Row(Cell(self.source, 0))])

    def tokenize(self, text: str) -> list[markup.Token]:
        """A text is tokenised once a document; searching finds partners of unclosed tags, so each use gets its own tokens."""
        if text not in self.tokens:
            if len(self.tokens) > 2000:
                self.tokens.clear()
            self.tokens[text] = markup.tokenize(text)
        return [replace(t) for t in self.tokens[text]]


def run(source: str | None, steps: tuple, url: str | None = None, variables: dict | None = None) -> Relation:
    """The relation that a query makes of a document; of NULL, an empty one."""
    if source is None:
        return Relation([])
    state = State(source.split("\0", 1)[0], url, {k.lower(): v for k, v in (variables or {}).items()})
    return advance(state, steps).relation


def advance(state: State, steps: tuple) -> State:
    for step in steps:
        take(state, step)
    return state


def take(state: State, step) -> None:
    if isinstance(step, Tag):
        select(state, step)
    elif isinstance(step, Schema):
        schema(state, step)
    elif isinstance(step, Reduce):
        state.relation = reduced(state.relation, step)
    elif isinstance(step, Function):
        from fathom.operators.steps import call

        call(state, step)
    elif isinstance(step, Group):
        advance(state, step.steps)
    elif isinstance(step, Source):
        set_source(state, step.text)
    elif isinstance(step, Complement):
        take(state, step.step)
        between(state)
    else:
        raise SyntaxProblem(f"{step!r} isn't a step")


def set_source(state: State, text: str) -> None:
    state.source, state.relation = text, Relation([Row(Cell(text, 0))])


def between(state: State) -> None:
    """The parts of the source before, between and after the rows."""
    at, out = 0, []
    for r in state.relation.rows:
        c = r.first()
        if c.at is None:
            continue
        out.append(Row(Cell(state.source[at : c.at], at)))
        at = max(at, c.at + len(c.text or ""))
    if at < len(state.source):
        out.append(Row(Cell(state.source[at:], at)))
    state.relation = Relation(out)


# ---- tag selection


def _options(state: State, tag: Tag) -> dict:
    out = dict(state.options)
    for name, on in tag.options:
        if name == "inclusive":
            out["plain_inclusive" if tag.kind == "plain" else "hyper_inclusive"] = on
        else:
            out[name] = on
    if tag.kind == "hyper" and ("separates", True) not in tag.options:
        out["separates"] = False
    return out


def select(state: State, tag: Tag) -> None:
    own = tag
    if tag.kind == "last":
        if state.last is None:
            raise SyntaxProblem("attributes without a tag before them")
        own = replace(state.last, gaps=False, conditions=(), ranges=(), attributes=tag.attributes)
    options = _options(state, own)
    again = tag.kind != "last" and state.last is not None and (own.kind, own.end) == (state.last.kind, state.last.end) and (own.name or "").lower() == (state.last.name or "").lower() and not state.options["separates"]
    rows: list[Row] = []
    for r in state.relation.rows:
        c = r.first()
        if c.text is None:
            continue
        if again or options["no_embed"]:
            c = Cell(c.text[c.head : len(c.text) - c.tail], None if c.at is None else c.at + c.head)
        rows += _within(state, own, options, c)
    state.options, state.last = options, own
    state.relation = Relation(rows, list(own.attributes) or None)


def _hits(state: State, tag: Tag, options: dict, tokens: list[markup.Token], text: str):
    """Indexes of the matching tokens, in order."""
    label = (tag.name or "").lower()
    if tag.kind == "plain":
        k = 0
        while k < len(tokens):
            yield k
            k = tokens[k].partner + 1 if tokens[k].partner is not None else k + 1
        return
    if tag.wild == "@":
        wanted = {"st": (markup.START,), "et": (markup.END,), "tt": (markup.START, markup.END), "tx": (markup.TEXT,)}.get(label, (markup.START, markup.END, markup.TEXT, markup.OTHER))
        yield from (k for k, t in enumerate(tokens) if t.kind in wanted)
        return
    last = (state.last.name or "").lower() if state.last is not None else None
    k = -1
    while (k := markup.search(tokens, k, label, tag.wild is not None, options["outermost"], options["no_embed"], last, options["no_frames"])) is not None:
        yield k


def span(tokens: list[markup.Token], k: int, text: str, inclusive: bool) -> tuple[int, int]:
    t = tokens[k]
    if t.kind == markup.TEXT or t.kind in (markup.END, markup.OTHER):
        return t.first, t.last
    first = t.first if inclusive else t.last
    if t.end is not None:
        return first, max(first, t.end + (t.end_size if inclusive else 0))
    if t.partner is not None and tokens[t.partner].first > t.first:
        return first, max(first, tokens[t.partner].first)
    return first, len(text)


def inner(tokens: list[markup.Token], k: int, text: str) -> tuple[int, int]:
    """Between start and end tag; a CDATA section is unwrapped."""
    a, b = span(tokens, k, text, False)
    m = re.compile(r"\s*<!\[CDATA\[", re.I).match(text, a, b)
    if m:
        stop = text.find("]]>", m.end(), b)
        return m.end(), b if stop < 0 else stop
    return a, b


def attribute(state: State, tokens: list[markup.Token], k: int, text: str, name: str) -> tuple[str | None, int | None]:
    """Value of an implicit or real attribute of a token, and where it lies in the text."""
    t, name = tokens[k], name.lower()
    cut = lambda a, b: (text[a:b], a)
    tag_before = lambda j: next((tokens[i] for i in range(j - 1, -1, -1) if tokens[i].kind in (markup.START, markup.END)), None)
    tag_after = lambda j: next((tokens[i] for i in range(j + 1, len(tokens)) if tokens[i].kind in (markup.START, markup.END)), None)
    to_tag = lambda a: text.find("<", a) if text.find("<", a) >= 0 else len(text)
    if name == "tn":
        m = re.compile(r"</?\s*([^\s/>]*)").match(text, t.first, t.last)
        return (m[1], m.start(1)) if m else (None, None)
    if name == "tx":
        return cut(*inner(tokens, k, text))
    if name == "ht":
        return cut(*span(tokens, k, text, True))
    if name == "st":
        p = tag_before(k) if t.kind == markup.TEXT else t
        return cut((p or t).first, (p or t).last)
    if name == "tt":
        return cut(t.first, t.last)
    if name == "et":
        return cut(t.end, t.end + t.end_size) if t.end is not None else ("", None)
    if name == "fx":
        n = tag_after(k)
        return cut(t.last, max(t.last, n.first) if n else to_tag(t.last))
    if name == "px":
        p = tag_before(k)
        return cut(p.last, t.first) if p else cut(t.first, t.first) if k == 0 else cut(0, t.first)
    if name in ("xx", "hx"):
        end = tokens[t.partner] if t.partner is not None and t.partner > k else t
        j = t.partner if t.partner is not None and t.partner > k else k
        n = tag_after(j)
        stop = max(end.last, n.first) if n else to_tag(end.last)
        return cut(end.last, stop) if name == "xx" else cut(t.first, stop)
    if name == "th" and t.label in ("td", "tr"):
        return header(tokens, k, text)
    if t.kind != markup.START:
        return None, None
    raw = text[t.first : t.last]
    v = markup.attributes(raw).get(name)
    at = raw.find(v) if v else -1
    return v, (t.first + at if at >= 0 else None)


def header(tokens: list[markup.Token], k: int, text: str) -> tuple[str | None, int | None]:
    """Of a cell the header above it, by its place in the row with colspans; of a row its first cell."""
    t = tokens[k]
    if t.label == "tr":
        first = next((j for j in range(k + 1, len(tokens)) if tokens[j].kind == markup.START and tokens[j].label in ("td", "th")), None)
        return (text[slice(*inner(tokens, first, text))], tokens[first].last) if first is not None else (None, None)
    row = next((j for j in range(k, -1, -1) if tokens[j].label == "tr" and tokens[j].kind == markup.START), None)
    table = next((j for j in range(k, -1, -1) if tokens[j].label == "table" and tokens[j].kind == markup.START), None)
    wide = lambda j: int(number(markup.attributes(text[tokens[j].first : tokens[j].last]).get("colspan", "1")) or 1)
    cells = lambda a, labels: [j for j in range(a, len(tokens)) if tokens[j].kind == markup.START and tokens[j].label in labels]
    place = sum(wide(j) for j in cells((row if row is not None else 0), ("td",)) if j < k)
    begin = table if table is not None else 0
    heads = [j for j in cells(begin, ("th",)) if table is None or tokens[table].end is None or tokens[j].first < tokens[table].end]
    if not heads:
        top = next(iter(cells(begin, ("tr",))), None)
        if top is None or top == row:
            return None, None
        following = next((j for j in cells(top + 1, ("tr",))), len(tokens))
        heads = [j for j in cells(top, ("td",)) if j < following]
    at = 0
    for j in heads:
        at += wide(j)
        if at > place:
            a, b = inner(tokens, j, text)
            return text[a:b], a
    return None, None


def _bounds(r: Range, total: int) -> tuple[int, int]:
    first = max(0, total + r.first) if r.first <= 0 else r.first
    last = total + r.last if r.last <= 0 else r.last
    return first, last if last >= first else -1


def in_range(ranges: tuple[Range, ...], index: int, total: int) -> tuple[bool, bool]:
    """Whether the index (from 1) is asked for, and whether it goes with the one asked for before it."""
    if not ranges:
        return True, False
    grouped = False
    for r in ranges:
        a, b = _bounds(r, total)
        inside = a <= index <= b
        if inside and r.per > 1 and (index - a) % r.per:
            grouped = True
        elif inside:
            return True, False
    return False, grouped


def _within(state: State, tag: Tag, options: dict, cell: Cell) -> list[Row]:
    text = cell.text
    offset = lambda a: None if cell.at is None or a is None else cell.at + a
    if tag.kind == "plain":
        tokens = markup.delimited(text, tag.name, tag.end, options["sensitive"])
    else:
        tokens = state.tokenize(text)
    inclusive = options["plain_inclusive" if tag.kind == "plain" else "hyper_inclusive"]
    hits = list(_hits(state, tag, options, tokens, text))
    wanted = set().union(*map(names_in, tag.conditions)) if tag.conditions else set()
    kept: list[tuple[int, bool]] = []
    for index, k in enumerate(hits, 1):
        ok, grouped = in_range(tag.ranges, index, len(hits)) if options["range_first"] else (True, False)
        if not (ok or grouped):
            continue
        if tag.conditions:
            row = {n.lower(): state.variables.get(n.lower(), attribute(state, tokens, k, text, n)[0]) for n in wanted}
            if not all(truth(value(c, row)) for c in tag.conditions):
                continue
        kept.append((k, grouped))
    rows: list[Row] = []
    if options["separates"]:
        begin = 0
        for k, _ in kept:
            a, b = (tokens[k].first, tokens[k].last) if tag.kind == "plain" else span(tokens, k, text, True)
            rows.append(Row(Cell(text[begin:a], offset(begin))))
            begin = a if inclusive else b
        rows.append(Row(Cell(text[begin:], offset(begin))))
    else:
        for k, grouped in kept:
            a, b = span(tokens, k, text, True) if inclusive else inner(tokens, k, text)
            t = tokens[k]
            c = Cell(text[a:b], offset(a), t.last - t.first if inclusive and t.kind == markup.START else 0, t.end_size if inclusive and t.end is not None else 0)
            if grouped and rows and not tag.attributes:
                rows[-1].base.text += c.text
                continue
            fields = None
            if tag.attributes:
                fields = []
                for n in tag.attributes:
                    v, p = (state.variables[n.lower()], None) if n.lower() in state.variables else attribute(state, tokens, k, text, n)
                    fields.append(Cell(v, offset(p)))
            rows.append(Row(c, fields))
    if not options["range_first"]:
        rows = [r for i, r in enumerate(rows, 1) if in_range(tag.ranges, i, len(rows))[0]]
    if tag.gaps:
        at, parts = 0, []
        for r in rows:
            if r.base.at is not None and cell.at is not None:
                parts.append(text[at : r.base.at - cell.at])
                at = max(at, r.base.at - cell.at + len(r.base.text))
        rows = [Row(Cell("".join(parts) + text[at:], cell.at))]
    if tag.attributes:
        for r in rows:
            if r.fields is None:
                r.fields = [Cell(None)] * len(tag.attributes)
    return rows


# ---- records


def schema(state: State, step: Schema) -> None:
    relation = state.relation
    if step.fields:
        names = [n or f"_{k + 1}" for k, (n, *_) in enumerate(step.fields)]
        rows = []
        for r in relation.rows:
            cells = []
            for _, place, steps in step.fields:
                start = r.first() if place is None else (r.cells()[place - 1] if place <= len(r.cells()) else Cell(None))
                inner_state = State(state.source, state.url, state.variables, dict(state.options), state.last, Relation([Row(start)]), state.tokens)
                found = advance(inner_state, steps).relation
                first = found.rows[0].first() if found.rows else Cell(None)
                cells.append(Cell(first.text, first.at, first.head, first.tail, found))
            rows.append(Row(cells[0], cells))
        relation = Relation(rows, names)
    if step.condition is not None:
        relation = Relation([r for r in relation.rows if truth(value(step.condition, state.variables | relation.record(r)))], relation.names)
    if step.outputs:
        first = relation.names[0] if relation.names else "_1"
        names = [n or (first if k == 0 else f"_{k + 1}") for k, (n, _) in enumerate(step.outputs)]
        rows = []
        for r in relation.rows:
            row = state.variables | relation.record(r)
            cells = [Cell(text_of(value(e, row))) for _, e in step.outputs]
            rows.append(Row(cells[0], cells))
        relation = Relation(rows, names)
    state.relation = relation


def joined(parts: list[str | None], separator: str) -> str:
    """Texts with separators; while nothing has come yet, none is put."""
    out = ""
    for p in parts:
        out = (out + separator if out else out) + (p or "")
    return out


def reduced(relation: Relation, step: Reduce) -> Relation:
    if step.depth == 0:
        return Relation([Row(Cell(joined([c.text for r in relation.rows for c in r.cells()], step.separator)))])
    if step.depth == 1:
        return Relation([Row(Cell(joined([c.text for c in r.cells()], step.separator))) for r in relation.rows])
    rows = []
    for r in relation.rows:
        cells = [Cell(joined([x.text for q in c.nested.rows for x in q.cells()], step.separator)) if c.nested else c for c in r.cells()]
        rows.append(Row(cells[0], cells if r.fields is not None else None))
    return Relation(rows, relation.names)


def each(state: State, step: Function, fn: Callable) -> None:
    """The first cell of every row becomes fn(text, *arguments)."""
    relation = state.relation
    for r in relation.rows:
        row = state.variables | relation.record(r)
        args = [value(a, row) for a in step.args]
        _set(r, Cell(fn(r.first().text, *args)))


def _set(r: Row, c: Cell) -> None:
    if r.fields:
        r.fields[0] = c
        r.base = c
    else:
        r.base = c
