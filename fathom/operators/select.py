"""Queries over a table of documents."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.columns import Typed, column
from fathom.plans.columns import condition as filter_of
from fathom.plans.expressions import SyntaxProblem
from fathom.plans.nodes import Schema
from fathom.plans.parser import field_names, parse

#: Documents whose result rows leave together.
BATCH = 500


def _lowered(steps: tuple) -> tuple[tuple, Schema | None]:
    """Splits a query: what needs the document, and the condition and outputs of a last record step, which are columns."""
    if steps and isinstance(steps[-1], Schema) and (steps[-1].condition is not None or steps[-1].outputs):
        last = steps[-1]
        kept = (*steps[:-1], replace(last, condition=None, outputs=())) if last.fields else steps[:-1]
        return kept, replace(last, fields=())
    return steps, None


def _rows(docs: DataFrame, steps: tuple, names: Sequence[str], source: str, url: str | None, keep: Sequence[str], variables: Mapping[str, str]) -> DataFrame:
    """k0, k1, ... (the kept columns), pos, f0, f1, ... (the fields) of every document's result rows."""
    slim = docs.select(*keep, F.col(source).cast("string").alias("_source"), (F.col(url).cast("string") if url in docs.columns else F.lit(None).cast("string")).alias("_url"))
    n_keep, width = len(keep), len(names)
    heads = [*(f"k{j}" for j in range(n_keep)), "pos", *(f"f{k}" for k in range(width))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fathom.operators.interpret import run

        for b in (b.slice(k, BATCH) for b in batches for k in range(0, b.num_rows, BATCH)):
            at, pos, cells = [], [], [[] for _ in range(width)]
            for k, (s, u) in enumerate(zip(b.column(n_keep).to_pylist(), b.column(n_keep + 1).to_pylist(), strict=True)):
                for i, r in enumerate(run(s, steps, u, variables).values()):
                    at.append(k)
                    pos.append(i)
                    for c, v in zip(cells, [*r, *[None] * (width - len(r))], strict=False):
                        c.append(v)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(take) for j in range(n_keep)), pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in cells)], heads)

    kinds = [f"k{j} {slim.schema[j].dataType.simpleString()}" for j in range(n_keep)]
    return slim.mapInArrow(rows, ", ".join([*kinds, "pos int", *(f"f{k} string" for k in range(width))]))


def query(docs: DataFrame, text: str, source: str = "html", url: str | None = "url", keep: Sequence[str] = ("page_id",), variables: Mapping[str, str] | None = None, nulls_as_empty: bool = False) -> DataFrame:
    """A row for each result row of each document: the kept columns, pos (document order, from 0), and the query's fields.

    Fields without a name are ``value``, or ``_n`` within records. The document part runs once a
    document, in Arrow batches and without a shuffle, so it works on streams too; a last record's
    condition and outputs become columns where built-in functions can say them. Documents that are
    NULL give no row. Other columns of docs are not read.
    """
    steps, given = parse(text), dict(variables or {})
    inside, after = _lowered(steps)
    names = field_names(inside) or ["value"]
    typed = [Typed(F.col(f"f{k}"), "text") for k in range(len(names))]
    fields = {f"%{k}": t for k, t in enumerate(typed, 1)} | {n.lower(): t for n, t in zip(names, typed, strict=True)} | {n.lower(): Typed(F.lit(v), "text") for n, v in given.items()}
    columns: list[tuple[str, Column]] = [(n, t.column) for n, t in zip(names, typed, strict=True)]
    condition = None
    try:
        if after is not None:
            condition = filter_of(after.condition, fields) if after.condition is not None else None
            columns = [(n or (names[0] if k == 0 else f"_{k + 1}"), column(e, fields).text()) for k, (n, e) in enumerate(after.outputs)] or columns
    except SyntaxProblem:  # no built-in form: all within the document
        inside, condition, names = steps, None, field_names(steps) or ["value"]
        columns = [(n, F.col(f"f{k}")) for k, n in enumerate(names)]
    found = _rows(docs, inside, names, source, url, keep, given)
    found = found if condition is None else found.where(condition)
    empty = (lambda c: F.coalesce(c, F.lit(""))) if nulls_as_empty else (lambda c: c)
    return found.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "pos", *[empty(c).alias(n) for n, c in columns])
