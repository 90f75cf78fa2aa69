"""The parsed form of a query: steps, and the expressions in them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    """kind: 'text', 'number' or 'date'."""

    value: object
    kind: str


@dataclass(frozen=True)
class Name:
    """A field by name, or by position as %n (from 1)."""

    name: str

    @property
    def position(self) -> int | None:
        return int(self.name[1:]) if self.name[:1] == "%" and self.name[1:].isdigit() else None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    value: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Range:
    """Positions first to last in steps of ``per``; 0 and below count from the end."""

    first: int
    last: int
    per: int = 1


@dataclass(frozen=True)
class Tag:
    """Selection of a tag. kind: 'hyper', 'plain' or 'last' (attributes of the tag selected before)."""

    kind: str
    name: str | None = None
    end: str | None = None
    wild: str | None = None
    gaps: bool = False
    options: tuple[tuple[str, bool], ...] = ()
    conditions: tuple = ()
    ranges: tuple[Range, ...] = ()
    attributes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    """Fields (name, position in the record before or None, steps), a condition, and output expressions."""

    fields: tuple[tuple[str, int | None, tuple], ...]
    condition: object | None = None
    outputs: tuple[tuple[str | None, object], ...] = ()


@dataclass(frozen=True)
class Reduce:
    """depth 0: all to one text; 1: the fields of each record; 2: the relation within each field."""

    separator: str
    depth: int = 0


@dataclass(frozen=True)
class Function:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Source:
    text: str


@dataclass(frozen=True)
class Complement:
    """What lies between the results of a step, in the whole source."""

    step: object


@dataclass(frozen=True)
class Group:
    steps: tuple = field(default=())
