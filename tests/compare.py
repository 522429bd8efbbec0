"""Run registered queries next to their SQL counterparts and compare the rows.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, function, sql, folder) -> tuple[bool, str]:
    start = time.time()
    frame = function(spark, folder)
    got = rows_of(frame.columns, frame.collect())
    spent = time.time() - start
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if got != want:
        return False, (
            f"{sorted(columns)} rows {sum(got.values())} != {sum(want.values())}\n  only spark "
            f"{list((got - want).items())[:3]}\n  only sql {list((want - got).items())[:3]}"
        )
    return True, f"{sum(got.values())} rows, {spent:.1f}s, sql {time.time() - start - spent:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from cartulary.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or list(queries):
        if name not in sql:
            start = time.time()
            print(f"---- {name}: no sql, {queries[name](spark, folder).count()} rows, {time.time() - start:.1f}s", flush=True)
            continue
        try:
            ok, text = compare(spark, con, name, queries[name], sql[name], folder)
        except Exception as error:  # report and go on with the other queries
            ok, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {text}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main())
