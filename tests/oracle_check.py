"""Compare registered queries with their DuckDB text: ``python tests/oracle_check.py sf0.01 [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return ([cols[i] for i in order],
            sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr))


def mismatch(spark_result, duck_result) -> str | None:
    (names, rows), (duck_names, duck) = spark_result, duck_result
    if names != duck_names:
        return f"columns {names} != {duck_names}"
    if len(rows) != len(duck):
        extra = [r for r in rows if r not in set(duck)][:2] if len(rows) < 5000 else []
        return f"{len(rows)} rows != {len(duck)} {rows[:1]} {duck[:1]} {extra}"
    for a, b in zip(rows, duck):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}\n   spark {a}\n   duck  {b}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from lintel.session import build_session

    sf, only = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(o in name for o in only):
            continue
        started = time.time()
        try:
            got = spark_rows(fn(spark, sf_dir))
            took = time.time() - started
            started = time.time()
            want = duck_rows(con, oracles[name]) if name in oracles else None
            verdict = "rows only" if want is None else mismatch(got, want) or "ok"
            duck_took = time.time() - started
        except Exception as e:
            got, verdict, took, duck_took = ([], []), "ERROR " + str(e)[:1500], time.time() - started, 0
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32} {len(got[1]):8} rows {took:6.2f}s duck {duck_took:5.2f}s {verdict}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
