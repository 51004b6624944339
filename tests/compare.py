"""Run registered queries against their reference SQL in DuckDB: rows, columns, types, values.

``python tests/compare.py [-d DIR] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(dtype: str) -> str:
    """Type families that hash alike once collected."""
    d = str(dtype)
    if d.startswith(("int", "uint", "Int")):
        return "int"
    if d.startswith("float"):
        return "float"
    if d.startswith("datetime"):
        return "time"
    return "bool" if d.startswith("bool") else "text"


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return 0.0 if v == 0 else v
    return v


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(map(cell, r)) for r in pdf.itertuples(index=False)), key=repr)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = rows(got), rows(want)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if off:
        return f"{len(off)} of {len(a)} rows differ, e.g. {sorted(got.columns)}\n   got  {off[0][0]}\n   want {off[0][1]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from airgrid.queries import REGISTRY
    from airgrid.session import build_session

    spark = build_session(master="local[8]", **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.d)
    failed = 0
    for name, q in REGISTRY.items():
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        start = time.time()
        try:
            df = q.run(spark, args.d)
            got = df.toPandas()
            took = time.time() - start
            if q.sql is None:
                print(f"rows  {name:28s} {took:6.2f}s {len(got)} rows {df.columns}", flush=True)
                continue
            want_rel = con.sql(q.sql)
            want = want_rel.df()
            problem = differences(got, want)
            types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
            sql_types = dict(zip(want_rel.columns, map(str, want_rel.types)))
            names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}
            off = [(n, t, sql_types.get(n)) for n, t in types if names.get(t) != sql_types.get(n)]
            if problem is None and off:
                problem = f"types {off}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, took, got = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, []
        failed += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {name:28s} {took:6.2f}s {len(got)} rows {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
