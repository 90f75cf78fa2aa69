"""Comparing a query's rows with those of its SQL."""


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(connection, sql):
    q = connection.sql(sql)
    names = sorted(q.columns)
    at = [q.columns.index(n) for n in names]
    return names, sorted(tuple(plain(r[i]) for i in at) for r in q.fetchall())


def plain(v):
    return "NULL" if v is None or v != v else repr(v)
