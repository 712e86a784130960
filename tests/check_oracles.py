"""Compare registered queries with their SQL in DuckDB: python tests/check_oracles.py DIR [names...]"""

import decimal
import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tierworks.plans.oracle import ORACLE  # noqa: E402
from tierworks.plans.registry import QUERIES  # noqa: E402
from tierworks.session import build_session  # noqa: E402
from tierworks.sources.raw import PARQUET_TABLES  # noqa: E402


def connect(directory):
    con = duckdb.connect()
    for t in PARQUET_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{directory}/{t}.parquet'")
    return con


def normal(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, bool) or value is None:
        return value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(normal(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, name, directory):
    """None if both sides agree, else what differs."""
    df = QUERIES[name](spark, directory)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[name])
    right = rows_of([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        only_l = sorted(set(left[1]) - set(right[1]))
        only_r = sorted(set(right[1]) - set(left[1]))
        return f"{len(left[1])} vs {len(right[1])} rows; {left[0]}\n    spark {only_l[:2]}\n    sql   {only_r[:2]}"
    return None


if __name__ == "__main__":
    where, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    session = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="tierworks-wh-"),
        },
    )
    duck, failed = connect(where), 0
    for n in names:
        if n not in ORACLE:
            print("no-sql", n, flush=True)
            continue
        t = time.time()
        try:
            diff = compare(session, duck, n, where)
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:500]}"
        failed += diff is not None
        print(("ok    " if diff is None else "DIFF  "), n, f"{time.time() - t:.1f}s", diff or "", flush=True)
    print("failed:", failed)
