"""Compare a registered query with its SQL on one data folder."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else f
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def sort_key(row):
    return tuple((x is None, str(type(x)), round(x, 5) if isinstance(x, float) else str(x)) for x in row)


def compare(spark_rows, cols, con, sql):
    """Message for the first difference, or None."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != sorted(cols):
        return f"columns {sorted(cols)} vs {sorted(names)}"
    order = sorted(cols)
    a = sorted((tuple(cell(r[c]) for c in order) for r in spark_rows), key=sort_key)
    idx = [names.index(c) for c in order]
    b = sorted((tuple(cell(r[i]) for i in idx) for r in rel.fetchall()), key=sort_key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    for x, y in zip(a, b):
        for c, u, v in zip(order, x, y):
            if not same(u, v):
                return f"{c}: {u!r} vs {v!r}\n   spark {dict(zip(order, x))}\n   sql   {dict(zip(order, y))}"
    return None


def main(sf: str, only: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from zonometry.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not only or any(n == o or (o.endswith("*") and n.startswith(o[:-1])) for o in only)]
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf)
            rows = df.collect()
            msg = compare(rows, df.columns, con, sql[name]) if name in sql else f"no sql; {len(rows)} rows"
            ok = msg is None or msg.startswith("no sql")
        except Exception as e:  # report and go on to the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
            rows = []
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {time.time() - t:6.2f}s rows={len(rows)} {msg or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
