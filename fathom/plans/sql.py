"""The table dialect: SELECT, DELETE, UPDATE and INSERT over a table, CREATE and DROP over a set of them, as DataFrame operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.columns import Typed, column
from fathom.plans.columns import condition as filter_of
from fathom.plans.expressions import Parser, SyntaxProblem, names_in
from fathom.plans.nodes import Binary, Call, Name, Unary

AGGREGATES = ("count", "sum", "max", "min")
TYPES = ("number", "integer", "char", "date")
CLAUSES = ("where", "group", "order", "having")
CREATED = {"number": "double", "integer": "long", "date": "timestamp"}


def fields_of(df: DataFrame) -> dict[str, Typed]:
    """Columns by name in lower case, and by position as %n."""
    out = {}
    for k, f in enumerate(df.schema.fields, 1):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            typed = Typed(c, "bool")
        elif isinstance(f.dataType, T.NumericType):
            typed = Typed(c.cast("double"), "number")
        elif isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            typed = Typed(c.cast("timestamp"), "date")
        else:
            typed = Typed(c.cast("string"), "text")
        out[f.name.lower()] = out[f"%{k}"] = typed
    return out


class Clauses(Parser):
    """Reads the clauses of a statement; an expression ends where a clause's word begins."""

    def keyword(self, *words: str) -> bool:
        if self.word() == words[0]:
            self.advance()
            for w in words[1:]:
                if self.word() != w:
                    raise SyntaxProblem(f"{w.upper()} is missing at {self.start} in {self.text!r}")
                self.advance()
            return True
        return False

    def listed(self, read) -> list:
        out = [read()]
        while self.is_op(","):
            self.advance()
            out.append(read())
        return out

    def output(self) -> tuple[str | None, object]:
        if self.is_op("*"):
            self.advance()
            return None, "*"
        e = self.expression()
        if self.keyword("as"):
            return self.advance(), e
        return (e.name if isinstance(e, Name) else None), e

    def order(self) -> tuple[object, str | None, bool]:
        e, kind, down = self.expression(), None, False
        while (w := self.word()) in (*TYPES, "asc", "desc"):
            self.advance()
            if w in TYPES:
                kind = w
            else:
                down = w == "desc"
        return e, kind, down


def execute(df: DataFrame, statement: str) -> DataFrame:
    """The statement's result; of DELETE, UPDATE and INSERT, the table as it is after."""
    p = Clauses(statement.strip().rstrip(";"))
    if p.keyword("select"):
        return _select(df, p)
    if p.keyword("delete"):
        p.keyword("from")
        _table(p)
        condition = p.expression() if p.keyword("where") else None
        return df.limit(0) if condition is None else df.where(~column(condition, fields_of(df)).truth())
    if p.keyword("update"):
        _table(p)
        return _update(df, p)
    if p.keyword("insert"):
        p.keyword("into")
        _table(p)
        return _insert(df, p)
    raise SyntaxProblem(f"no statement begins so: {statement!r}")


def execute_over(tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """SELECT over several tables, FROM a, b [AS x], (SELECT ...) y WHERE ...: columns are named by table (a.c) or, where that is clear, alone.

    Equal columns in WHERE make Spark's planner join by them; nothing is multiplied out first.
    """
    p = Clauses(statement.strip().rstrip(";"))
    at = [(execute_over(tables, name) if name not in tables and name[:6].lower() == "select" else tables[name], alias) for name, alias in _from(p)]
    if len(at) == 1:
        df, alias = at[0]
        p = Clauses(statement.strip().rstrip(";"))
        p.keyword("select")
        return _select(df, p, {f"{alias}.{c}".lower(): c for c in df.columns})
    whole, names = None, {}
    for table, alias in at:
        df = table.select(*[F.col(f"`{c}`").alias(f"{alias}__{c}") for c in table.columns])
        for c in table.columns:
            names[f"{alias}.{c}".lower()] = f"{alias}__{c}"
            names[c.lower()] = f"{alias}__{c}" if c.lower() not in names else None
        whole = df if whole is None else whole.crossJoin(df)
    p = Clauses(statement.strip().rstrip(";"))
    p.keyword("select")
    return _select(whole, p, {k: v for k, v in names.items() if v})


def _from(p: Clauses) -> list[tuple[str, str]]:
    """(table or the text of a nested SELECT, alias) of the FROM clause, which is read past."""
    while p.kind != "end" and p.word() != "from":
        p.advance()
    p.advance()

    def one():
        name = _nested(p) if p.is_op("(") else p.advance()
        if p.keyword("as") or (p.kind == "name" and p.word() not in CLAUSES):
            return name, p.advance()
        return name, name

    return p.listed(one)


def _nested(p: Clauses) -> str:
    """The text between a parenthesis and the one that closes it, which is read past."""
    first, depth = p.next, 0
    while p.kind not in ("end", "bad"):
        depth += p.is_op("(") - p.is_op(")")
        if not depth:
            text = p.text[first : p.start]
            p.advance()
            return text.strip()
        p.advance()
    raise SyntaxProblem(f"')' is missing in {p.text!r}")


def change(tables: dict[str, DataFrame], statement: str) -> dict[str, DataFrame]:
    """A set of tables as it is after CREATE TABLE t (c type, ...), DROP TABLE t, INSERT, UPDATE or DELETE. Columns without a type are text."""
    p, out = Clauses(statement.strip().rstrip(";")), dict(tables)
    if p.keyword("create", "table"):
        name = p.advance()
        if name in out or not p.is_op("("):
            raise SyntaxProblem(f"{name!r} is there already" if name in out else f"'(' is missing at {p.start} in {p.text!r}")
        p.advance()

        def one() -> T.StructField:
            c, kind = p.advance().strip('"[]'), (p.advance().lower() if p.kind == "name" else "char")
            if p.is_op("("):
                _nested(p)
            return T.StructField(c, T._parse_datatype_string(CREATED.get(kind, "string")))

        fields = p.listed(one)
        if not p.is_op(")") or p.advance() and p.kind != "end":
            raise SyntaxProblem(f"')' is missing at {p.start} in {p.text!r}")
        out[name] = SparkSession.active().createDataFrame([], T.StructType(fields))
        return out
    dropped = p.keyword("drop", "table")
    if not dropped and not (p.keyword("delete") or p.keyword("update") or p.keyword("insert")):
        raise SyntaxProblem(f"no change begins so: {statement!r}")
    if not dropped:
        p.keyword("from") or p.keyword("into")
    name = p.advance()
    if name not in out:
        raise SyntaxProblem(f"there is no table {name!r}")
    if dropped:
        del out[name]
    else:
        out[name] = execute(out[name], statement)
    return out


def _table(p: Clauses) -> None:
    if p.kind == "name" and p.word() not in ("where", "set", "values", "group", "order", "having"):
        p.advance()


def _update(df: DataFrame, p: Clauses) -> DataFrame:
    if not p.keyword("set"):
        raise SyntaxProblem("SET is missing")

    def one():
        name = p.advance().strip('"[]')
        if not p.is_op("="):
            raise SyntaxProblem("'=' is missing")
        p.advance()
        return name, p.expression()

    changes = p.listed(one)
    fields = fields_of(df)
    where = column(p.expression(), fields).truth() if p.keyword("where") else F.lit(True)
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    new = {}
    for name, e in changes:
        own = next((c for c in df.columns if c.lower() == name.lower()), None)
        if own is None:
            raise SyntaxProblem(f"there is no column {name!r}")
        v = column(e, fields)
        new[own] = F.when(where, (v.text() if isinstance(kinds[own.lower()], T.StringType) else v.column).try_cast(kinds[own.lower()])).otherwise(F.col(f"`{own}`"))
    return df.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def _insert(df: DataFrame, p: Clauses) -> DataFrame:
    names = df.columns
    if p.is_op("("):
        p.advance()
        names = p.listed(lambda: p.advance().strip('"[]'))
        p.advance()
    if not p.keyword("values"):
        raise SyntaxProblem("VALUES is missing")
    rows = []

    def one():
        p.advance()
        rows.append(p.listed(p.expression))
        p.advance()

    p.listed(one)
    lower = [n.lower() for n in names]
    spark = df.sparkSession
    added = None
    for r in rows:
        made = [column(e, {}) for e in r]
        values = [(made[lower.index(f.name.lower())] if f.name.lower() in lower else None) for f in df.schema.fields]
        row = spark.range(1).select(*[(F.lit(None) if v is None else v.text() if isinstance(f.dataType, T.StringType) else v.column).try_cast(f.dataType).alias(f.name) for v, f in zip(values, df.schema.fields, strict=True)])
        added = row if added is None else added.unionByName(row)
    return df.unionByName(added)


def _without_aggregates(node, found: dict[str, Call]):
    """The expression with each aggregate as a field of its own."""
    if isinstance(node, Call):
        if node.name in AGGREGATES:
            name = f"agg{len(found)}"
            found[name] = node
            return Name(name)
        return replace(node, args=tuple(_without_aggregates(a, found) for a in node.args))
    if isinstance(node, Unary):
        return replace(node, value=_without_aggregates(node.value, found))
    if isinstance(node, Binary):
        return replace(node, left=_without_aggregates(node.left, found), right=_without_aggregates(node.right, found))
    return node


def _aggregate(call: Call, fields: dict[str, Typed]) -> Column:
    """count counts rows times arguments; the others are numeric over all arguments."""
    args = [column(a, fields).number() for a in call.args]
    if call.name == "count":
        return (F.count(F.lit(1)) * max(1, len(args))).cast("double")
    if call.name == "sum":
        return F.sum(sum(args[1:], args[0]))
    fold = F.greatest if call.name == "max" else F.least
    each = args[0] if len(args) == 1 else fold(*args)
    return (F.max if call.name == "max" else F.min)(each)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with row numbers from 1 in its order of partitions; each partition is numbered by itself and shifted by those before."""
    part, row = "fx_part", "fx_row"
    marked = df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id()})
    sizes = marked.groupBy(part).agg(F.count(F.lit(1)).alias("fx_n"))
    starts = sizes.select(part, (F.sum("fx_n").over(Window.orderBy(part)) - F.col("fx_n")).alias("fx_start"))  # a row for each partition
    return marked.join(starts, part).withColumn(name, (F.row_number().over(Window.partitionBy(part).orderBy(row)) + F.col("fx_start")).cast("double")).drop(part, row, "fx_n", "fx_start")


def _select(df: DataFrame, p: Clauses, names: dict[str, str] | None = None, nested: bool = False) -> DataFrame:
    unique = p.keyword("unique") or p.keyword("distinct")
    outputs = p.listed(p.output)
    if names is not None:
        _from(p)
    elif p.keyword("from"):
        if p.is_op("("):
            p.advance()
            if not p.keyword("select"):
                raise SyntaxProblem(f"SELECT is missing at {p.start} in {p.text!r}")
            df = _select(df, p, nested=True)
            p.advance()
            p.keyword("as")
        _table(p)
    where = p.expression() if p.keyword("where") else None
    groups = p.listed(p.expression) if p.keyword("group", "by") else None
    having = p.expression() if p.keyword("having") else None
    orders = p.listed(p.order) if p.keyword("order", "by") else []
    if not (p.is_op(")") if nested else p.kind == "end"):
        raise SyntaxProblem(f"{p.value!r} at {p.start} isn't expected in {p.text!r}")
    read = set().union(*[names_in(e) for _, e in outputs if e != "*"], names_in(where) if where else set())
    if "rownum" in {n.lower() for n in read} and "rownum" not in {c.lower() for c in df.columns}:
        df = numbered(df, "rownum")
        outputs = [o for o in outputs if o[1] != "*"] + [(c, Name(c)) for o in outputs if o[1] == "*" for c in df.columns if c != "rownum"]
    outputs = [x for o in outputs for x in ([(c, Name(c)) for c in df.columns] if o[1] == "*" else [o])]
    outputs = [(n or f"_{k}", e) for k, (n, e) in enumerate(outputs, 1)]
    fields = fields_of(df)
    fields |= {k: fields[v.lower()] for k, v in (names or {}).items()}
    if where is not None:
        df = df.where(filter_of(where, fields))
    found: dict[str, Call] = {}
    plain = [(n, _without_aggregates(e, found)) for n, e in outputs]
    having = _without_aggregates(having, found) if having is not None else None
    orders = [(_without_aggregates(e, found), k, d) for e, k, d in orders]
    if found or groups is not None:
        keys = [column(g, fields) for g in groups or []]
        by_key = {f"key{k}": t for k, t in enumerate(keys)}
        same = {g: f"key{k}" for k, g in enumerate(groups or [])}
        others = {n.lower() for _, e in plain if e not in same for n in names_in(e) if n not in found and n.lower() in fields}
        if others:  # other columns are those of a group's last row, in the table's order
            df = df.withColumn("fx_place", F.monotonically_increasing_id())
        aggs = [_aggregate(c, fields).alias(n) for n, c in found.items()] + [F.max_by(fields[n].column, F.col("fx_place")).alias(f"last_{n}") for n in sorted(others)]
        grouped = df.groupBy(*[t.column.alias(n) for n, t in by_key.items()])
        df = grouped.agg(*aggs) if aggs else grouped.agg(F.count(F.lit(1)).alias("fx_n"))
        fields = {n: Typed(F.col(f"last_{n}"), fields[n].kind) for n in sorted(others)} | {n: Typed(F.col(n), "number") for n in found} | {n: Typed(F.col(n), t.kind) for n, t in by_key.items()}
        fields |= {g.name.lower(): fields[k] for g, k in same.items() if isinstance(g, Name)}
        plain = [(n, Name(same[e]) if e in same else e) for n, e in plain]
    made = [(n, column(e, fields)) for n, e in plain]
    fields = {n.lower(): t for n, t in made} | fields
    if having is not None:
        df = df.where(filter_of(having, fields))
    keys = []
    for e, kind, down in orders:
        t = column(e, fields)
        c = {"number": t.number, "integer": lambda t=t: t.number().cast("long"), "date": t.date, "char": t.text, None: lambda t=t: t.column}[kind]()
        keys.append(c.desc() if down else c.asc())
    if keys and not unique:
        df = df.orderBy(*keys)
    out = df.select(*[t.column.alias(n) for n, t in made])
    if unique:
        out = out.distinct()
        names = {n.lower(): n for n, _ in made}
        keys = [(F.col(f"`{names[e.name.lower()]}`").desc() if d else F.col(f"`{names[e.name.lower()]}`")) for e, _, d in orders if isinstance(e, Name) and e.name.lower() in names]
        out = out.orderBy(*keys) if keys else out
    return out
