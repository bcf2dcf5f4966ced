"""Run registered queries beside their SQL checks and compare whole results.

As a script: python tests/compare.py <folder> [name prefix ...]
"""

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else 0.0 if v == 0 else v
    return v


def _kind(v) -> str:
    return "int" if isinstance(v, int) and not isinstance(v, bool) else type(v).__name__


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(map(repr, r)))


def difference(query, sql: str, spark, folder: str, con) -> str | None:
    df = query(spark, folder)
    mine, rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    theirs, expected = canonical([d[0] for d in con.description], con.fetchall())
    if mine != theirs:
        return f"columns {mine} vs {theirs}"
    if len(rows) != len(expected):
        extra = [r for r in rows if r not in expected][:2]
        return f"{len(rows)} rows vs {len(expected)}; extra {extra}; expected {expected[:2]}"
    for row, other in zip(rows, expected):
        if row != other:
            return f"{row} vs {other}"
        if [_kind(v) for v in row] != [_kind(v) for v in other]:
            return f"types {[_kind(v) for v in row]} vs {[_kind(v) for v in other]}"
    return None if rows else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from vitalcells.registry import ORACLES, QUERIES
    from vitalcells.session import local_session

    folder, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark, con = local_session(), duck(sys.argv[1])
    bad = 0
    for name, run in QUERIES.items():
        if not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(run, ORACLES[name], spark, folder, con)
            else:
                n = len(run(spark, folder).collect())
                problem = None if n else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:36s} {time.time() - start:6.2f}s {'sql ' if name in ORACLES else 'rows'} "
              f"{problem or 'ok'}", flush=True)
    print(f"{bad} bad")
