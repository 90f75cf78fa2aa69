"""Queries on single documents, a cursor over their rows, and the functions for Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import SparkSession

from fathom.operators.interpret import Relation, run
from fathom.operators.select import query as query_table
from fathom.operators.steps import catalogue, register
from fathom.plans.parser import field_names, parse

__all__ = ["Cursor", "catalogue", "query", "query_table", "register", "register_sql"]


def query(source: str | None, text: str, url: str | None = None, variables: Mapping[str, str] | None = None, nulls_as_empty: bool = True) -> list[tuple]:
    """The rows that a query makes of one document, always as tuples."""
    rows = run(source, parse(text), url, dict(variables or {})).values()
    return [tuple("" if v is None and nulls_as_empty else v for v in r) for r in rows]


class Cursor:
    """A query's rows one by one. ``then`` appends steps; iteration gives a bare text where there is one field."""

    def __init__(self, source: str | None, text: str = "", url: str | None = None, variables: Mapping[str, str] | None = None) -> None:
        self.source, self.text, self.url, self.variables = source, text, url, dict(variables or {})
        self.at, self._relation = 0, None

    def then(self, more: str) -> Cursor:
        return Cursor(self.source, f"{self.text}.{more}" if self.text else more, self.url, self.variables)

    def set_variable(self, name: str, value: str) -> None:
        self.variables[name] = value
        self._relation = None

    @property
    def relation(self) -> Relation:
        if self._relation is None:
            self._relation = run(self.source, parse(self.text), self.url, self.variables)
        return self._relation

    def fields(self) -> list[str]:
        return field_names(parse(self.text)) or ["value"]

    def rows(self, spans: bool = False) -> list[tuple]:
        """All rows; with spans, (position, length) in the source of each cell, position None where it isn't from there."""
        if spans:
            return [tuple((c.at, len(c.text or "")) for c in r.cells()) for r in self.relation.rows]
        return [tuple(c.text or "" for c in r.cells()) for r in self.relation.rows]

    def __iter__(self) -> Iterator:
        for r in self.rows():
            yield r[0] if len(r) == 1 else r

    def __len__(self) -> int:
        return len(self.relation.rows)

    def __getitem__(self, key: int | str):
        """A field of the current row, by number (from the end below 0) or name."""
        cells = self.relation.rows[self.at].cells()
        if isinstance(key, str):
            key = [f.lower() for f in self.fields()].index(key.lower())
        return cells[key].text or ""

    def first(self) -> None:
        self.at = 0

    def last(self) -> None:
        self.at = max(0, len(self) - 1)

    def next(self) -> None:
        self.at += 1

    def previous(self) -> None:
        self.at -= 1

    def is_end(self) -> bool:
        return self.at >= len(self)

    def is_begin(self) -> bool:
        return self.at < 0


def register_sql(spark: SparkSession) -> None:
    """Makes doc_query(html, query, url) a table function of the session: pos, fields (array of text) of each row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos: int, fields: array<string>")
    class DocQuery:
        def eval(self, html: str, text: str, url: str):
            for k, r in enumerate(run(html, parse(text), url).values()):
                yield k, r

    spark.udtf.register("doc_query", DocQuery)
