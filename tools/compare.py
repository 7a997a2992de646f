"""Run registered queries beside their SQL and compare the rows.

python tools/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def cell(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return "nan" if math.isnan(f) else repr(f + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, name, function, sql, sf):
    df = function(spark, sf)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(left)}", True
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    right = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", False
    if left == right:
        return f"equal {len(left)}" + ("" if left else "  EMPTY"), bool(left)
    ours, theirs = set(left), set(right)
    a, b = [x for x in left if x not in theirs], [x for x in right if x not in ours]
    return f"DIFFERENT {len(left)} vs {len(right)} cols {sorted(columns)}\n   spark {a[:2]}\n   sql   {b[:2]}", False


def connect(sf):
    import duckdb
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def main():
    from attest.catalog import oracles, queries
    from attest.session import local_session
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf), oracles(), []
    for name, function in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, name, function, sqls.get(name), sf)
        except Exception as error:  # report and go on
            text, ok = f"{type(error).__name__}: {str(error)[:700]}", False
        print(f"{name:10s} {time.time() - start:6.2f}s {text}", flush=True)
        if not ok:
            bad.append(name)
    print("BAD", bad)
    spark.stop()


if __name__ == "__main__":
    main()
