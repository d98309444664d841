"""Compare a query with its SQL on DuckDB: columns by name, rows without order."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(data: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(data).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v + 0.0:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if isinstance(v, (bool, str, bytes, type(None))) else float(v) if hasattr(v, "__float__") else v


def assert_same(spark, data, query, sql):
    df = query(spark, data)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    con = connect(data)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    order = [cols.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    extra, missing = got - want, want - got
    assert not extra and not missing, f"{sum(extra.values())} extra {list(extra)[:3]}, {sum(missing.values())} missing {list(missing)[:3]}, of {sum(want.values())}"
    return sum(got.values())
