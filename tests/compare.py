"""Order-insensitive comparison of Spark rows and DuckDB rows."""

import math


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None:
        return "null"
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(df, duck, sql):
    rows, cols = df.collect(), sorted(df.columns)
    rel = duck.sql(sql)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in cols) for r in rows)
    assert got == want
