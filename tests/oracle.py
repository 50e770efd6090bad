"""A query's rows against DuckDB's, as sorted rows with columns in order of name."""

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())


def agree(spark, function, sql, folder=SMALL):
    df = function(spark, folder)
    con_rows, own = duck_rows(sql, folder), spark_rows(df)
    assert len(own) == len(con_rows)
    assert own == con_rows
