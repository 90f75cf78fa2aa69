"""Orders and unique keys of tables, as an index has them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.plans.expressions import SyntaxProblem
from fathom.plans.sql import fields_of

FLAGS = ("desc", "ci", "char", "integer", "float", "date", "length")


def _key(df: DataFrame, name: str, flags: str) -> Column:
    words = flags.lower().split()
    if unknown := set(words) - set(FLAGS):
        raise SyntaxProblem(f"no flags of an order: {sorted(unknown)}")
    fields = fields_of(df)
    if name.lower() not in fields:
        raise SyntaxProblem(f"there is no column {name!r}")
    t = fields[name.lower()]
    if "length" in words:
        c = F.octet_length(t.text())
    elif "integer" in words or "float" in words:
        c = t.number().cast("long") if "integer" in words else t.number()
    elif "date" in words:
        c = t.date()
    else:
        c = t.text() if {"char", "ci"} & set(words) else t.column
        c = F.lower(c) if "ci" in words else c
    return c.desc() if "desc" in words else c.asc()


def ordered(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """df in the order of (column, flags): desc, ci (case aside), char, integer, float, date, length. NULL comes first, last with desc."""
    return df.orderBy(*[_key(df, n, f) for n, f in keys])


def insert_unique(df: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df and those rows of added whose key df lacks; of several with one key the first in added's order. NULL equals NULL.

    One shuffle of added by key, and a join with df's keys, both on the keys; rows that df has are kept as they are.
    """
    place = "fx_place"
    first = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(place)
    new = added.select(*[F.col(f"`{c}`") for c in df.columns]).withColumn(place, F.monotonically_increasing_id())
    new = new.withColumn("fx_n", F.row_number().over(first)).where("fx_n = 1").drop("fx_n", place).alias("a")
    known = df.select(*[F.col(f"`{k}`") for k in keys]).alias("b")
    same = reduce(Column.__and__, [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys])
    return df.unionByName(new.join(known, same, "left_anti"))
