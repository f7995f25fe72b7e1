"""Compare every catalogue query with its SQL twin in DuckDB.

    python tests/check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_points  # noqa: E402
from gaugeflow.session import local_session  # noqa: E402

DUCK_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
              "date": "DATE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def key(row):
    return tuple((v is None, str(type(v)) if v is None else v) for v in row)


def compare(df, con, sql) -> list[str]:
    problems = []
    expected_types = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    found_types = {n: DUCK_TYPES.get(t, t) for n, t in df.dtypes}
    if expected_types != found_types:
        wrong = {c: (found_types.get(c), expected_types.get(c))
                 for c in {*found_types, *expected_types}
                 if found_types.get(c) != expected_types.get(c)}
        problems.append(f"types {wrong}")
        if set(expected_types) != set(found_types):
            return problems
    names = sorted(found_types)
    found = sorted((tuple(r) for r in df.select(*names).collect()), key=key)
    columns = ", ".join(f'"{n}"' for n in names)
    expected = sorted(con.execute(f"SELECT {columns} FROM ({sql})").fetchall(), key=key)
    if len(found) != len(expected):
        problems.append(f"rows {len(found)} != {len(expected)}")
    wrong = [(a, b) for a, b in zip(found, expected) if a != b]
    if wrong:
        a, b = wrong[0]
        problems.append(f"{len(wrong)} of {len(found)} rows differ, e.g. " + str(
            {n: (x, y) for n, x, y in zip(names, a, b) if x != y}))
    if not found:
        problems.append("no rows")
    return problems


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), entry_points.oracle_sql(), 0
    for name, query in entry_points.queries().items():
        if (wanted and name not in wanted) or name not in sqls:
            continue
        start = time.time()
        try:
            problems = compare(query(spark, sf_dir), con, sqls[name])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:26s} {time.time() - start:6.2f}s "
              + "; ".join(problems)[:900], flush=True)
    print(f"{failed} failed; no SQL for {sorted(set(entry_points.queries()) - set(sqls))}")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(1 if main(args[0] if args else "/root/testdata/sf0.01", args[1:]) else 0)
