"""Run registered queries next to their check SQL.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    return repr(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return normal(names, cur.fetchall())


def difference(got, want):
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        lost = [r for r in want[1] if r not in set(got[1])][:3]
        return f"{len(got[1])} rows != {len(want[1])}; columns {got[0]}; only spark {extra}; only sql {lost}"
    return None


def main(sf_dir, names):
    import __spark_entry__ as entry
    from millrace.session import build_session
    if os.environ.get("PLAIN_SESSION"):   # a session without any of our settings
        spark = SparkSession.builder.master("local[8]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    else:
        spark = build_session("compare")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        t = time.time()
        try:
            got = spark_result(queries[name](spark, sf_dir))
            took = time.time() - t
            if name in oracles:
                why = difference(got, sql_result(con, oracles[name]))
            else:
                why = None if got[1] else "no rows"
        except Exception as e:  # noqa: BLE001
            took, why = time.time() - t, f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if why else 'ok  '} {kind} {took:6.2f}s {name}  {why or len(got[1])}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
