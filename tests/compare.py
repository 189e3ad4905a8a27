"""Run queries against their DuckDB oracle and report differences.

python tests/compare.py [name-part ...]   (COMPARE_SF picks the folder)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf, function, sql) -> str | None:
    df = function(spark, sf)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        mine, other = set(ours), set(theirs)
        left, right = sorted(mine - other, key=repr)[:2], sorted(other - mine, key=repr)[:2]
        return f"rows {len(ours)} != {len(theirs)}; ours {left}; oracle {right}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ: {sorted(df.columns)} ours {bad[0][0]} oracle {bad[0][1]}"
    if not ours:
        return "both sides are empty"
    return None


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from panelmark.session import build_session

    sf = os.environ.get("COMPARE_SF", "/root/testdata/sf0.01")
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    wanted = sys.argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, function in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = difference(spark, con, sf, function, oracles[name])
            else:
                problem = None if function(spark, sf).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in oracles else "rows"
        if problem:
            failed += 1
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:5.1f}s {name} {problem or ''}",
              flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
