"""Compare registered queries with their SQL in DuckDB.

    python tests/check_queries.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v: object) -> str:
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, Decimal)) or isinstance(v, float):
        f = float(v)
        return "nan" if math.isnan(f) else f"{f:.10g}" if not f.is_integer() else str(int(f)) if abs(f) < 1e15 else repr(f)
    if isinstance(v, datetime):
        return v.date().isoformat() if v.time().isoformat() == "00:00:00" else v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return str(v)


def table(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(con, spark, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    began = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"rows={len(got)} (no SQL) {took:.1f}s"
    began = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - began
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = table(df.columns, got), table(names, want)
    if a != b:
        only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return False, f"rows {len(a)} vs {len(b)}; cols {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"
    return True, f"rows={len(a)} {took:.1f}s (sql {sql_took:.1f}s)"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{args.sf}"
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            ok, note = compare(con, spark, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note = False, "".join(traceback.format_exception_only(exc))[:1500]
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
