"""Spark's rows and the checking engine's, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def table_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def differences(df, con, sql) -> str:
    """Empty if the query and the SQL give the same columns and rows."""
    got = table_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = table_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]}, SQL {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, SQL {len(want[1])}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b:
            return f"{a}, SQL {b}"
    return ""
