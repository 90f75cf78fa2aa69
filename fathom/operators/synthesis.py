"""Queries found from examples: what leads to given elements of a document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from fathom.operators import markup

#: Elements around the wanted ones that a query may go through.
AROUND = 4


def element_at(tokens: Sequence[markup.Token], at: int | None) -> int | None:
    """The element whose start tag holds a place, or, if none does, the last whose content begins there."""
    if at is None:
        return None
    starts = [k for k, t in enumerate(tokens) if t.kind == markup.START]
    return next((k for k in starts if tokens[k].first <= at < tokens[k].last), next((k for k in reversed(starts) if tokens[k].last == at), None))


def _quoted(v: str) -> str | None:
    return f"'{v}'" if "'" not in v and "\\" not in v and v else None


def _numbered(tokens: Sequence[markup.Token], k: int, source: str, since: int = -1) -> str:
    """An element as a step: by an id that no other element has, else by its number among those of its name after a token."""
    own = _quoted(markup.attributes(source[tokens[k].first : tokens[k].last]).get("id") or "")
    if own and sum(1 for t in tokens if t.kind == markup.START and markup.attributes(source[t.first : t.last]).get("id") == own[1:-1]) == 1:
        return f"<{tokens[k].label} (id={own})>1"
    return f"<{tokens[k].label} NORECUR>{sum(1 for t in tokens[since + 1 : k + 1] if t.kind == markup.START and t.label == tokens[k].label)}"


def candidates(tokens: Sequence[markup.Token], source: str, wanted: Sequence[int]) -> Iterator[tuple[int, str]]:
    """(how many elements around it goes through, query) for elements of one name."""
    label = tokens[wanted[0]].label
    each = [markup.attributes(source[tokens[k].first : tokens[k].last]) for k in wanted]
    shared = [(n, v) for n, v in each[0].items() if all(e.get(n) == v for e in each)]
    ends = [f"<{label}>", f"<{label} NORECUR>"] + [f"<{label} ({n}={q})>" for n, v in shared[:4] if (q := _quoted(v)) and n.replace("-", "").isalnum()]
    first, last = wanted[0], wanted[-1]
    around = [k for k, t in enumerate(tokens[:first]) if t.kind == markup.START and t.label != label and t.partner is not None and t.partner > last]
    for depth, k in enumerate([None, *reversed(around[-AROUND:])]):
        head = "" if k is None else _numbered(tokens, k, source) + "."
        for e in ends:
            yield depth, head + e
        if len(wanted) == 1:
            yield depth, head + _numbered(tokens, first, source, -1 if k is None else k)


def ranked(state, places: Sequence[int | None], long: bool = False) -> list[str]:
    """The queries that give some of the elements at the places, by how well what they give agrees with them (twice the shared over
    the sum of both), then the shortest way first, or with ``long`` the one through the most elements. None if names differ."""
    from fathom.operators.interpret import State, advance
    from fathom.plans.parser import parse

    tokens = state.tokenize(state.source)
    wanted = sorted({k for a in places if (k := element_at(tokens, a)) is not None})
    if not wanted or len({tokens[k].label for k in wanted}) > 1:
        return []
    targets, scored = {tokens[k].first for k in wanted}, []
    for depth, q in dict.fromkeys(candidates(tokens, state.source, wanted)):
        tried = State(state.source, state.url, state.variables, tokens=state.tokens)  # the source's tokens are made once
        got = {r.base.at for r in advance(tried, parse(q)).relation.rows}
        if both := len(got & targets):
            scored.append((-2 * both / (len(got) + len(targets)), -depth if long else depth, len(q), q))
    return [q for *_, q in sorted(scored)]
