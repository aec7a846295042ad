"""A query's rows held against its DuckDB SQL over the same tables."""

import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, decimal.Decimal)) and v == int(v):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}" if v != int(v) else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def both(query, sql, spark, sf_dir):
    """(rows of the query, rows of the SQL), columns and rows sorted."""
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(sql)
    listed = [c[0] for c in found.description]
    assert sorted(listed) == names
    places = [listed.index(c) for c in names]
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    want = sorted((tuple(plain(r[k]) for k in places) for r in found.fetchall()), key=key)
    return got, want
