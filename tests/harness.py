"""Run a registered query in Spark and its SQL in DuckDB and compare them strictly.

    python -m tests.harness [sf folder] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Spark type -> DuckDB type of the same result column.
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    clean = frame.astype(object).where(frame.notna(), None)
    return sorted(clean.itertuples(index=False, name=None), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Problems found, empty when the results are the same."""
    got, rel = df.toPandas(), con.sql(sql)
    want = rel.df()
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    duck_types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if TYPES.get(kind) != duck_types[name]:
            out.append(f"type of {name}: {kind} / {duck_types[name]}")
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}")
    if not a:
        out.append("empty result")
    return out


def main() -> None:
    import __spark_entry__ as entry
    from delaylens.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark, con = local_session(8), duck(folder)
    sqls, failed = entry.oracle_sql(), 0
    for name, plan in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = plan(spark, folder)
            problems = differences(df, con, sqls[name]) if name in sqls else []
            note = "" if name in sqls else f"(rows only: {df.count()})"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s {note}", flush=True)
        for p in problems:
            print("     ", p, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
