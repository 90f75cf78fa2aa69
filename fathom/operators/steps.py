"""The &functions of the query language."""

from __future__ import annotations

import re
from collections.abc import Callable

from fathom.functions.scalar import FUNCTIONS as SCALAR
from fathom.functions.scalar import html_decode_text, lookup, number, text_of
from fathom.functions.urls import URL_ATTRIBUTE, resolve
from fathom.operators import markup, synthesis
from fathom.operators.evaluate import truth, value
from fathom.operators.interpret import Cell, Relation, Row, State, advance, each, inner, set_source, span
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.nodes import Function

#: On one text: name to function(text, *arguments).
TEXT: dict[str, Callable] = {}

#: On the state: name to function(state, step).
WHOLE: dict[str, Callable] = {}

#: Added by callers: name to function(text, *arguments).
ADDED: dict[str, Callable] = {}


def on_text(fn: Callable) -> Callable:
    TEXT[fn.__name__.rstrip("_")] = fn
    return fn


def on_state(fn: Callable) -> Callable:
    WHOLE[fn.__name__.rstrip("_")] = fn
    return fn


def register(name: str, fn: Callable) -> None:
    """Makes a function of the caller a step: fn(text, *arguments) -> text."""
    ADDED[name.lower()] = fn


def call(state: State, step: Function) -> None:
    if step.name in ADDED:
        each(state, step, lambda t, *a: text_of(ADDED[step.name](t, *a)))
    elif step.name in WHOLE:
        WHOLE[step.name](state, step)
    elif step.name in TEXT:
        each(state, step, lambda t, *a: None if t is None else text_of(TEXT[step.name](t, *a)))
    elif (fn := lookup(step.name)) is not None:
        each(state, step, lambda t, *a: text_of(fn(t, *a)))
    else:
        raise SyntaxProblem(f"there is no function &{step.name}")


def _arguments(state: State, step: Function, row: Row | None = None) -> list:
    record = state.variables | (state.relation.record(row) if row else {})
    return [value(a, record) for a in step.args]


# ---- text


_HIDDEN = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_ANY_TAG = re.compile(r"<!--.*?-->|<[!?/a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
_PARAGRAPH = ("p", "br", "div", "tr", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6")


@on_text
def tx(text, space="", dot="", keep=""):
    """The text without tags, scripts and styles, entities decoded. space, dot: put where a paragraph ends; keep: tags that stay."""
    stay = {k.strip().lower() for k in (text_of(keep) or "").split("|") if k.strip()}
    put = ("" if not dot else text_of(dot)) + ("" if not space else text_of(space))

    def one(m: re.Match) -> str:
        label = re.match(r"</?\s*([\w:-]*)", m[0])[1].lower()
        return m[0] if label in stay else put if label in _PARAGRAPH else ""

    return html_decode_text(_ANY_TAG.sub(one, _HIDDEN.sub("", text)))


@on_text
def txstr(text, most=0):
    """tx with blanks, < and > collapsed; cut at ``most`` characters, then marked with $."""
    out = re.sub(r"[ \t\r\n<>]+", " ", tx(text)).strip()
    n = int(number(most))
    return out[:n] + "$" if n and len(out) > n else out


@on_text
def trim(text, chars=None, mark="1010"):
    """mark: a digit each for the start, the middle, the end, and everywhere."""
    chars = text_of(chars) if chars else " \t\n\r\x0b\x0c"
    lead, middle, trail, all_ = ((text_of(mark) or "").ljust(4, "0"))[:4]
    if mark == "1010":
        lead, middle, trail, all_ = "1", "0", "1", "0"
    one = re.escape(chars)
    if all_ == "1":
        return re.sub(f"[{one}]", "", text)
    if lead == "1":
        text = text.lstrip(chars)
    if trail == "1":
        text = text.rstrip(chars)
    if middle == "1":
        text = re.sub(f"(?<=[^{one}])[{one}]+(?=[^{one}])", lambda m: "\n" * min(2, m[0].count("\n")) or m[0][0], text)
    return text


@on_text
def toupper(text):
    return text.upper()


@on_text
def tolower(text):
    return text.lower()


@on_text
def char_replace(text, old="", new=""):
    old, new = text_of(old) or "", text_of(new) or ""
    table: dict = {}
    for k, c in enumerate(old):
        table.setdefault(ord(c), new[k] if k < len(new) else None)
    return text.translate(table)


def _occurrence(text: str, what: str, n: int) -> int:
    at = -1
    for _ in range(max(1, n)):
        at = text.find(what, at + 1)
        if at < 0:
            break
    return at


@on_text
def after(text, what, n=1):
    what = text_of(what) or ""
    at = _occurrence(text, what, int(number(n)))
    return text[at + len(what) :] if at >= 0 else ""


@on_text
def before(text, what, n=1):
    at = _occurrence(text, text_of(what) or "", int(number(n)))
    return text[:at] if at >= 0 else ""


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_DATES = [
    (re.compile(r"\b(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b"), (1, 2, 3)),
    (re.compile(r"\b(\d{4})年(\d{1,2})月(\d{1,2})日"), (1, 2, 3)),
    (re.compile(r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})\b"), (3, 1, 2)),
    (re.compile(r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"), (3, 1, 2)),
    (re.compile(r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"), (3, 2, 1)),
]


def dates(text: str) -> list[str]:
    """Dates in a text in order, as YYYY/MM/DD."""
    found = []
    for pattern, (y, m, d) in _DATES:
        for hit in pattern.finditer(text):
            month = _MONTHS.index(hit[m][:3].lower()) + 1 if hit[m][:3].lower() in _MONTHS else int(hit[m]) if hit[m].isdigit() else 0
            if 1 <= month <= 12 and 1 <= int(hit[d]) <= 31:
                found.append((hit.start(), f"{int(hit[y]):04d}/{month:02d}/{int(hit[d]):02d}"))
    out, last = [], -1
    for at, v in sorted(found):
        if at != last:
            out.append(v)
        last = at
    return out


@on_text
def get_date(text, which=1, exact=""):
    found, n = dates(text), int(number(which)) or 1
    return found[n - 1 if n > 0 else n] if 0 < abs(n) <= len(found) else ""


@on_text
def get_csvfield(text, separator=",", which=1):
    """The n-th field of a CSV line, from the end below 0; 0: all, one a line."""
    s = re.escape(text_of(separator) or ",")
    fields = [m[1].replace('""', '"') if m[1] is not None else m[2] for m in re.finditer(rf'(?:\A|{s})\s*(?:"((?:[^"]|"")*)"|((?:(?!{s}).)*))', text, re.S)]
    n = int(number(which))
    if n == 0:
        return "\n".join(fields)
    return fields[n - 1 if n > 0 else n] if abs(n) <= len(fields) else ""


@on_text
def tag_attrs(text):
    m = re.match(r"\s*<\s*([^\s/>]+)", text)
    if not m:
        return ""
    start = re.match(r"\s*<(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", text)
    rows = "".join(f'<tag_attr name="{k}" value="{SCALAR["html_encode"](v)}">' for k, v in markup.attributes((start[0] if start else text).strip()).items())
    return f'<tag_attrs tag_name="{m[1]}">{rows}</tag_attrs>'


@on_text
def html_encode(text):
    return SCALAR["html_encode"](text)


@on_text
def skip_header(text):
    return text.split("\r\n\r\n", 1)[1] if "\r\n\r\n" in text else text


# ---- state


@on_state
def tuple_count(state, step):
    state.relation = Relation([Row(Cell(str(len(state.relation.rows))))])


@on_state
def set_source_(state, step):
    args = _arguments(state, step)
    set_source(state, text_of(args[0]) if args else (state.relation.rows[0].first().text or "" if state.relation.rows else ""))


WHOLE["set_source"] = WHOLE.pop("set_source", set_source_)


@on_state
def remove_header(state, step):
    set_source(state, skip_header(state.source))


def base_url(state: State) -> str | None:
    """The page's own base, else the URL that came with it."""
    m = re.search(r"<base\b[^>]*>", state.source, re.I)
    own = markup.attributes(m[0]).get("href") if m else None
    return own or state.url


@on_state
def url(state, step):
    base = base_url(state)
    each(state, step, lambda t, *a: None if t is None else resolve(t, base))


@on_state
def get_url(state, step):
    def one(text, *a):
        m = re.match(r"\s*<(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", text or "")
        if not m:
            return None
        label = re.match(r"\s*<\s*([^\s/>]+)", m[0])[1].lower()
        return markup.attributes(m[0].strip()).get(URL_ATTRIBUTE.get(label, "href"))

    each(state, step, one)


@on_state
def url_all(state, step):
    """All URL attributes in the text, resolved in place."""
    base = base_url(state)

    def one(text, *a):
        if text is None:
            return None

        def tag(m: re.Match) -> str:
            label = m[1].lower()
            name = URL_ATTRIBUTE.get(label, "href") if label in (*URL_ATTRIBUTE, "a", "area", "link", "base") else None
            if name is None:
                return m[0]
            return re.sub(rf"""(\b{name}\s*=\s*)("[^"]*"|'[^']*'|[^\s>]+)""", lambda v: v[1] + '"' + SCALAR["html_encode"](resolve(v[2].strip("\"'"), base)) + '"', m[0], count=1, flags=re.I)

        return re.sub(r"<([a-zA-Z]+)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", tag, text)

    each(state, step, one)


def _tokens_at(state: State, at: int | None) -> tuple[list[markup.Token], int | None]:
    tokens = state.tokenize(state.source)
    return tokens, next((k for k, t in enumerate(tokens) if t.first == at), None) if at is not None else None


def _replace_rows(state: State, fn: Callable) -> None:
    """Each row becomes the cell that fn(tokens, index of its token, arguments) gives, or goes."""
    rows = []
    for r in state.relation.rows:
        tokens, k = _tokens_at(state, r.first().at)
        c = fn(tokens, k, r) if k is not None else None
        if c is not None:
            rows.append(Row(c))
    state.relation = Relation(rows)


def _element(state: State, tokens: list[markup.Token], k: int) -> Cell:
    a, b = span(tokens, k, state.source, True)
    return Cell(state.source[a:b], a, tokens[k].last - tokens[k].first, tokens[k].end_size)


@on_state
def tag_parent(state, step):
    """The innermost element around each row, of the name given if any."""

    def one(tokens, k, r):
        args = _arguments(state, step, r)
        name = (text_of(args[0]) or "").strip("<> ").lower() if args else ""
        at = tokens[k].first
        around = [j for j in range(k) if tokens[j].kind == markup.START and (not name or tokens[j].label == name) and tokens[j].partner != j and span(tokens, j, state.source, True)[1] > at]
        return _element(state, tokens, around[-1]) if around else None

    _replace_rows(state, one)


@on_state
def tag_next(state, step):
    def one(tokens, k, r):
        n = int(number((_arguments(state, step, r) or [1])[0])) or 1
        for _ in range(n):
            begin = tokens[k].partner + 1 if tokens[k].partner is not None and tokens[k].partner > k else k + 1
            k = next((j for j in range(begin, len(tokens)) if tokens[j].kind == markup.START), None)
            if k is None:
                return None
        return _element(state, tokens, k)

    _replace_rows(state, one)


@on_state
def tag_prev(state, step):
    def one(tokens, k, r):
        n = int(number((_arguments(state, step, r) or [1])[0])) or 1
        for _ in range(n):
            k = next((j for j in range(k - 1, -1, -1) if tokens[j].kind == markup.START), None)
            if k is None:
                return None
        return _element(state, tokens, k)

    _replace_rows(state, one)


@on_state
def tag_index(state, step):
    """The ordinal of each row's tag among those of its name in the source, as an element."""
    args = _arguments(state, step)
    use = text_of(args[1]) if len(args) > 1 else "0"

    def one(tokens, k, r):
        label = tokens[k].label
        n = sum(1 for t in tokens[: k + 1] if t.kind == markup.START and t.label == label)
        named = markup.attributes(state.source[tokens[k].first : tokens[k].last])
        ident = next((x for x in ("name", "id") if x in named), "")
        return Cell(f'<tag_index tag="{label}" nameid="{ident}" namevalue="{named.get(ident, "")}" index="{n}" use_name="{use}">')

    _replace_rows(state, one)


@on_state
def tag_leaves(state, step):
    """Elements that the next token closes, or that hold one text only."""
    rows = []
    for r in state.relation.rows:
        c = r.first()
        tokens = state.tokenize(c.text or "")
        for k, t in enumerate(tokens):
            if t.kind == markup.START and t.partner is not None and t.partner in (k + 1, k + 2) and all(x.kind == markup.TEXT for x in tokens[k + 1 : t.partner]):
                a, b = span(tokens, k, c.text, True)
                rows.append(Row(Cell(c.text[a:b], None if c.at is None else c.at + a, t.last - t.first, t.end_size)))
    state.relation = Relation(rows)


@on_state
def offset(state, step):
    a, n = (int(number(x)) for x in _arguments(state, step)[:2])
    state.relation = Relation([Row(Cell(state.source[a : a + n], a))])


@on_state
def position(state, step):
    for r in state.relation.rows:
        c = r.first()
        a, n = c.at if c.at is not None else -1, len(c.text or "")
        r.base, r.fields = Cell(f'<position from="{a}" to="{a + n}" length="{n}">'), None
    state.relation.names = None


@on_state
def refine_null_fields(state, step):
    least = number(step.args and value(step.args[0], {}) or 0.7)
    state.relation.rows = [r for r in state.relation.rows if sum(not (c.text or "").strip() for c in r.cells()) < least * len(r.cells())]


@on_state
def html_title(state, step):
    """The title; without one, the first heading."""
    for name in ("title", "h1", "h2", "h3"):
        s = State(state.source, state.url, state.variables)
        from fathom.plans.parser import parse

        found = advance(s, parse(f"<{name}>1:tx &txstr")).relation.values()
        if found and found[0][0]:
            state.relation = Relation([Row(Cell(found[0][0]))])
            return
    state.relation = Relation([])


@on_state
def form_inputs(state, step):
    """The controls of each row's form, as elements of one text."""
    rows = []
    for r in state.relation.rows:
        c = r.first()
        tokens, out, esc = state.tokenize(c.text or ""), [], SCALAR["html_encode"]
        for k, t in enumerate(tokens):
            if t.kind != markup.START or t.label not in ("input", "select", "textarea", "button"):
                continue
            have = markup.attributes(c.text[t.first : t.last])
            kind = have.get("type", "text" if t.label == "input" else t.label)
            shown = have.get("value", "")
            if t.label == "textarea":
                shown = c.text[slice(*inner(tokens, k, c.text))]
            near = next((tx(c.text[x.first : x.last]).strip() for x in reversed(tokens[:k]) if x.kind == markup.TEXT and c.text[x.first : x.last].strip()), "")
            options = ""
            if t.label == "select":
                a, b = inner(tokens, k, c.text)
                for o in re.finditer(r"(<option\b[^>]*>)([^<]*)", c.text[a:b], re.I):
                    has = markup.attributes(o[1])
                    v = has.get("value", o[2].strip())
                    options += f'<option value="{esc(v)}" text="{esc(o[2].strip())}">'
                    if "selected" in has or not shown:
                        shown = v
            out.append(f'<form_input name="{esc(have.get("name", ""))}" id="{esc(have.get("id", ""))}" value="{esc(shown)}" type="{esc(kind)}" description="{esc(near)}">{options}</form_input>')
        rows.append(Row(Cell(f"<form_inputs>{''.join(out)}</form_inputs>")))
    state.relation = Relation(rows)


@on_state
def html_main_text(state, step):
    """The part of the page with the most text for its markup: of the block elements, the one that holds most sentences outside links."""
    tokens = state.tokenize(state.source)
    best, chosen = 0.0, None
    for k, t in enumerate(tokens):
        if t.kind == markup.START and t.label in ("article", "main", "section", "div", "td", "body"):
            a, b = inner(tokens, k, state.source)
            piece = state.source[a:b]
            plain = len(tx(piece))
            linked = sum(len(tx(m[1])) for m in re.finditer(r"<a\b[^>]*>(.*?)</a>", piece, re.S | re.I))
            score = (plain - 2 * linked) * (plain / max(1, len(piece)))
            if score > best * 1.0001:
                best, chosen = score, (a, b)
    state.relation = Relation([Row(Cell(re.sub(r"\s*\n\s*", "\n", tx(state.source[slice(*chosen)], "\n")).strip(), chosen[0]))] if chosen else [])


@on_state
def html_main_date(state, step):
    html_main_text(state, step)
    found = dates(state.relation.rows[0].base.text) if state.relation.rows else []
    state.relation = Relation([Row(Cell(found[0]))] if found else [])


@on_state
def html_key_text(state, step):
    """Of the elements that hold every key, the innermost."""
    keys = [text_of(a) or "" for a in _arguments(state, step)]
    tokens = state.tokenize(state.source)
    hits = [k for k, t in enumerate(tokens) if t.kind == markup.START and t.partner != k and all(x in tx(state.source[slice(*inner(tokens, k, state.source))]) for x in keys)]
    state.relation = Relation([Row(_element(state, tokens, hits[-1]))] if hits else [])


@on_state
def repeat_patterns(state, step):
    """Runs of tag names that occur twice or more in a row's text, best first by length times count."""
    most = int(number((_arguments(state, step) or [10])[0])) or 10
    rows = []
    for r in state.relation.rows:
        names = [("/" if t.kind == markup.END else "") + t.label for t in state.tokenize(r.first().text or "") if t.kind in (markup.START, markup.END)]
        found: dict[tuple, int] = {}
        for n in range(2, min(9, len(names) + 1)):
            for i in range(len(names) - n + 1):
                g = tuple(names[i : i + n])
                found[g] = found.get(g, 0) + 1
        good = sorted(((len(g) * c, g, c) for g, c in found.items() if c > 1), key=lambda x: (-x[0], x[1]))[:most]
        rows += [Row(Cell(f'<pattern count="{c}" score="{s}">{" ".join(g)}</pattern>')) for s, g, c in good]
    state.relation = Relation(rows)


def _path_query(state: State, at: int) -> str | None:
    """A query that gives the element at a place: its name and its number among those, through its parent's if that is unique."""
    tokens = state.tokenize(state.source)
    k = next((k for k, t in enumerate(tokens) if t.kind == markup.START and t.first <= at < t.last), None)
    if k is None:
        return None
    label = tokens[k].label
    n = sum(1 for t in tokens[:k] if t.kind == markup.START and t.label == label) + 1
    named = markup.attributes(state.source[tokens[k].first : tokens[k].last]).get("id")
    if named and state.source.count(f'id="{named}"') == 1:
        return f"<{label} (id='{named}')>1"
    return f"<{label} NORECUR>{n}"


@on_state
def find_query(state, step):
    """Queries that give the rows' elements, one a line and best first. Arguments: 'short' (or 0) or 'long' (or 3), which of equally good ones come first; how many at most."""
    args = _arguments(state, step)
    long = bool(args) and text_of(args[0]) in ("long", "3")
    found = synthesis.ranked(state, [r.base.at if r.base.at is not None else r.first().at for r in state.relation.rows], long)
    if not found:  # no query gives them together: one for each
        found = [q for r in state.relation.rows if (q := _path_query(state, r.base.at if r.base.at is not None else -1))]
    most = int(number(args[1])) if len(args) > 1 else 10
    state.relation = Relation([Row(Cell("\n".join(list(dict.fromkeys(found))[:most])))])


@on_state
def find_focus_query(state, step):
    """The best query that goes through an element around the rows', the nearest that serves."""
    found = synthesis.ranked(state, [r.base.at if r.base.at is not None else r.first().at for r in state.relation.rows])
    state.relation = Relation([Row(Cell(next((q for q in found if re.search(r">\d+\.<", q)), found[0] if found else "")))])


@on_state
def find_leaves_query(state, step):
    """A query for each leaf element of the rows, one a line."""
    tag_leaves(state, step)
    found = [q for r in state.relation.rows if (q := _path_query(state, r.first().at if r.first().at is not None else -1))]
    state.relation = Relation([Row(Cell("\n".join(dict.fromkeys(found))))])


WHOLE["tag_leaves_query"] = WHOLE["find_leaves_query"]


def _text_leaves(state: State) -> list[tuple[int, str, int, int]]:
    """(number among the source's texts, text, first, last) of the texts that lie within the rows and aren't blank."""
    spans = [(c.at, c.at + len(c.text or "")) for r in state.relation.rows if (c := r.base).at is not None]
    texts = [t for t in state.tokenize(state.source) if t.kind == markup.TEXT]
    return [(n, v, t.first, t.last) for n, t in enumerate(texts, 1) if (v := tx(state.source[t.first : t.last]).strip()) and any(a <= t.first and t.last <= b for a, b in spans)]


@on_state
def plain_leaves_query(state, step):
    """A query for each text within the rows, one a line."""
    state.relation = Relation([Row(Cell("\n".join(f"<@tx>{n}:tt" for n, *_ in _text_leaves(state))))])


@on_state
def key_leaves_query(state, step):
    """A record query with a field for each key: the text that follows the first text which holds the key."""
    leaves, fields = _text_leaves(state), []
    for key in (text_of(a) or "" for a in _arguments(state, step)):
        k = next((k for k, leaf in enumerate(leaves) if key.lower() in leaf[1].lower()), None)
        if k is not None and k + 1 < len(leaves):
            fields.append(f"{re.sub(r'[^A-Za-z0-9_]+', '_', key).strip('_') or f'f{len(fields) + 1}'}=<@tx>{leaves[k + 1][0]}:tt")
    state.relation = Relation([Row(Cell("{" + "; ".join(fields) + "}"))])


@on_state
def leaves_schema_query(state, step):
    """A record query with a field for each leaf of the first row's text."""
    c = state.relation.rows[0].first() if state.relation.rows else Cell(None)
    tag_leaves(state, step)
    tokens, seen, fields = state.tokenize(c.text or ""), {}, []
    for k, t in enumerate(tokens):
        if t.kind == markup.START:
            seen[t.label] = seen.get(t.label, 0) + 1
            if t.partner is not None and t.partner in (k + 1, k + 2) and all(x.kind == markup.TEXT for x in tokens[k + 1 : t.partner]):
                fields.append(f"f{len(fields) + 1}=<{t.label} NORECUR>{seen[t.label]}:tx")
    state.relation = Relation([Row(Cell("{" + "; ".join(fields) + "}"))])


def _views(state: State) -> list[tuple[float, int, str, int]]:
    """(score, token, label of the repeated child, how many) of the elements that hold a child's name twice or more."""
    tokens, out = state.tokenize(state.source), []
    depth: list[int] = []
    children: dict[int, dict[str, int]] = {}
    for k, t in enumerate(tokens):
        if t.kind == markup.START and t.partner is not None and t.partner > k:
            if depth:
                own = children.setdefault(depth[-1], {})
                own[t.label] = own.get(t.label, 0) + 1
            depth.append(k)
        elif t.kind == markup.END and t.partner in depth:
            del depth[depth.index(t.partner) :]
    for k, own in children.items():
        label, n = max(own.items(), key=lambda x: (x[1], x[0]))
        if n > 1:
            size = len(tx(state.source[slice(*span(tokens, k, state.source, True))]).strip())
            out.append((size * (1 - 1 / n), k, label, n))
    return sorted(out, key=lambda v: (-v[0], v[1]))


@on_state
def find_repeat_views(state, step):
    """The elements that look most like lists: how much text they hold in how many children of one name."""
    args = [int(number(a)) for a in _arguments(state, step)]
    found = _views(state)[: (args or [5])[0]]
    tokens = state.tokenize(state.source)
    out = []
    for score, k, label, n in found:
        own = _path_query(state, tokens[k].first)
        out.append(Row(Cell(f'<view query="{SCALAR["html_encode"](own or "")}.&lt;{label}&gt;" count="{n}" score="{score:.0f}">', tokens[k].first)))
    state.relation = Relation(out)


@on_state
def find_best_views(state, step):
    """The best of the lists, as elements."""
    args = [int(number(a)) for a in _arguments(state, step)]
    tokens = state.tokenize(state.source)
    state.relation = Relation([Row(_element(state, tokens, k)) for _, k, *_ in _views(state)[: (args or [1])[0]]])


@on_state
def substr_(state, step):
    """Part of each row's text by place and length; its place in the source is kept."""
    for r in state.relation.rows:
        args = [int(number(a)) for a in _arguments(state, step, r)]
        c, a = r.first(), max(0, args[0])
        text = (c.text or "")[a : a + args[1]] if len(args) > 1 else (c.text or "")[a:]
        new = Cell(text, None if c.at is None else c.at + a)
        if r.fields:
            r.fields[0] = r.base = new
        else:
            r.base = new


@on_state
def help_(state, step):
    state.relation = Relation([Row(Cell("".join(f'<function name="{n}">' for n in catalogue())))])


@on_state
def about(state, step):
    from fathom import __version__

    state.relation = Relation([Row(Cell(f'<about version="{__version__}">'))])


def catalogue() -> list[str]:
    """Names of all steps and functions."""
    return sorted({*TEXT, *WHOLE, *SCALAR, *ADDED})


@on_state
def format_html_results(state, step):
    """The relation as an HTML table; the first argument: whether cells are encoded; the second: rows at most."""
    args = _arguments(state, step)
    esc = SCALAR["html_encode"] if args and truth(args[0]) else (lambda x: x)
    rows = state.relation.rows[: int(number(args[1])) or None] if len(args) > 1 else state.relation.rows
    width = max((len(r.cells()) for r in rows), default=0)
    names = state.relation.names or [f"%{k + 1}" for k in range(width)]
    head = "<tr>" + "".join(f"<th>{esc(n)}</th>" for n in names) + "</tr>"
    body = "".join("<tr>" + "".join(f"<td>{esc(c.text or '')}</td>" for c in r.cells()) + "</tr>" for r in rows)
    state.relation = Relation([Row(Cell(f"<table>{head}{body}</table>"))])


# ---- updates of the source


def _edit(state: State, step: Function, change: Callable) -> None:
    """Applies change(cell, arguments) -> (place, length, text) of each row to the source, in order; overlapping later ones are left out."""
    edits = []
    for r in state.relation.rows:
        c = r.first()
        if c.at is not None and (e := change(c, _arguments(state, step, r))) is not None:
            edits.append(e)
    out, at = [], 0
    for a, n, text in sorted(edits, key=lambda e: e[0]):
        if a < at:
            continue
        out += [state.source[at:a], text]
        at = a + n
    set_source(state, "".join(out) + state.source[at:])


def _start_tag(c: Cell) -> re.Match | None:
    return re.match(r"<[^\s/>]+(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", c.text or "")


@on_state
def insert(state, step):
    _edit(state, step, lambda c, a: (c.at, 0, text_of(a[0]) or ""))


@on_state
def insert_after(state, step):
    _edit(state, step, lambda c, a: (c.at + len(c.text or ""), 0, text_of(a[0]) or ""))


@on_state
def delete(state, step):
    _edit(state, step, lambda c, a: (c.at, len(c.text or ""), ""))


@on_state
def update(state, step):
    _edit(state, step, lambda c, a: (c.at, len(c.text or ""), text_of(a[0]) or ""))


@on_state
def replace_(state, step):
    """With one argument as update; with two, within the row's text only."""
    if len(step.args) > 1:
        each(state, step, lambda t, old, new: None if t is None else t.replace(text_of(old) or "", text_of(new) or ""))
    else:
        update(state, step)


@on_state
def set_attribute(state, step):
    def one(c, args):
        m = _start_tag(c)
        if m is None:
            return None
        name, v = text_of(args[0]) or "", text_of(args[1]) or ""
        quote = '"' if '"' not in v else "'"
        put = f"{name}={quote}{v if '\"' not in v or chr(39) not in v else v.replace(chr(39), '&#39;')}{quote}"
        old = re.search(rf"""(?<=\s){re.escape(name)}(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", m[0], re.I)
        if old:
            return c.at + old.start(), old.end() - old.start(), put
        at = re.match(r"<[^\s/>]+", m[0]).end()
        return c.at + at, 0, " " + put

    _edit(state, step, one)


@on_state
def delete_attribute(state, step):
    def one(c, args):
        m = _start_tag(c)
        old = m and re.search(rf"""\s{re.escape(text_of(args[0]) or "")}(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", m[0], re.I)
        return (c.at + old.start(), old.end() - old.start(), "") if old else None

    _edit(state, step, one)
