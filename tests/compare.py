"""Run queries and their SQL side by side: ``python -m tests.compare [folder] [name…]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tipweave")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool):
        return v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return columns, cur.fetchall()


def compare(spark, folder: str, name: str, fn, sql: str | None):
    """None if both sides agree, else what differs."""
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None if got else "no rows", len(got)
    columns, want_rows = oracle(folder, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}", len(got)
    want = rows_of(columns, want_rows)
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:3] if len(got) < 50000 else []
        return f"{len(got)} rows against {len(want)}\n  only here: {extra}\n  only sql: {missing}", len(got)
    return None, len(got)


def main(argv):
    import __spark_entry__ as entry_points
    from tipweave.runtime import drop_work

    QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = session()
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, folder, name, QUERIES[name], SQL.get(name))
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += problem is not None
        took = time.time() - start
        kind = "" if name in SQL else " (rows only)"
        print(f"{'ok ' if problem is None else 'BAD'} {name}{kind} rows={n} {took:.1f}s", flush=True)
        drop_work(spark)
        if problem:
            print("   ", problem[:2500], flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
