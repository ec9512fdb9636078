"""Row comparison of a Spark result and a DuckDB relation, columns by name, rows in any order."""

import math


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    if isinstance(v, dict):
        return repr(sorted((str(k), norm(x)) for k, x in v.items()))
    return str(v)


def same(df, relation):
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    at = [relation.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[k]) for k in at) for r in relation.fetchall())
    return len(got)
