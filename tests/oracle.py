"""Side-by-side run of a registered query and its SQL on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    """A comparable form: engine-specific number and list types are unified."""
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "item"):
        return value.item()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    cols_a, a = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols_b, b = rows_of([c[0] for c in cur.description], cur.fetchall())
    out = []
    if cols_a != cols_b:
        out.append(f"columns {cols_a} != {cols_b}")
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    if not out and a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"{len(bad)} rows differ, first {bad[0]}")
    types_a = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    types_b = {c[0]: str(c[1]).lower() for c in cur.description}
    for name, t in types_a.items():
        ints_a, ints_b = t in ("int", "bigint", "smallint"), "int" in types_b.get(name, "")
        dbl_a, dbl_b = t in ("double", "float"), types_b.get(name, "") in ("double", "float")
        if name in types_b and (ints_a != ints_b or dbl_a != dbl_b):
            out.append(f"type of {name}: {t} != {types_b[name]}")
    return out
