"""Order-free comparison of a Spark result with DuckDB SQL over the same files."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.6f}".rstrip("0").rstrip(".")
    return str(v)


def duck_rows(sql: str, sf: str = SF):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(names), sorted(tuple(norm(r[names.index(n)]) for n in sorted(names)) for r in cur.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(norm(r[n]) for n in names) for r in df.collect())
