"""Run registered queries on Spark and their SQL on DuckDB, and compare: python tests/oracle_check.py [dir] [name...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v

    made = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((v is None, str(v)) for v in r))


def same(a, b) -> bool:
    if a is None or b is None or isinstance(a, str) or isinstance(b, str):
        return a == b
    return a == b


def compare(spark, con, run, sql, folder):
    df = run(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if not sql:
        return len(rows), "rows only"
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    types = [str(x[1]) for x in cur.description]
    want = comparable(cur.fetchall(), names)
    got = comparable(rows, df.columns)
    if sorted(names) != sorted(df.columns):
        return len(rows), f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if len(want) != len(got):
        return len(rows), f"row counts differ: {len(got)} / {len(want)}"
    for g, w in zip(got, want):
        if not all(same(x, y) for x, y in zip(g, w)):
            return len(rows), f"values differ:\n   spark {g}\n   duck  {w}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
             "FLOAT": "float", "SMALLINT": "smallint", "TINYINT": "tinyint"}
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [(n, spark_types[n], t) for n, t in zip(names, types)
           if kinds.get(t, t) != spark_types[n] and not (t.startswith("TIMESTAMP"))]
    return len(rows), f"ok{' TYPES ' + str(odd) if odd else ''}"


def main() -> int:
    import __spark_entry__ as e
    from tidemill.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session("8", spark__ui__showConsoleProgress="false"), duck(folder)
    bad = 0
    for name, run in e.queries().items():
        if args and name not in args:
            continue
        start = time.time()
        try:
            n, verdict = compare(spark, con, run, e.oracle_sql().get(name), folder)
        except Exception as error:
            n, verdict = -1, "ERROR " + "".join(traceback.format_exception_only(error))[:700]
            if args:
                traceback.print_exc()
        bad += not verdict.startswith(("ok", "rows only")) or "TYPES" in verdict
        print(f"{name:32s} {n:7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print("not matching:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
