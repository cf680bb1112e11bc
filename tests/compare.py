"""Runs catalogue queries on Spark and their SQL in an in-process engine; compares whole results."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("customer", "supplier", "part", "orders", "lineitem", "documents", "pages")


def engine(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return db


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def differences(spark, db, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if not wanted:
        return "no rows"
    if got != wanted:
        extra, missing = list((got - wanted).items())[:2], list((wanted - got).items())[:2]
        return f"{sum(got.values())} rows, expected {sum(wanted.values())}; extra {extra}; missing {missing}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as contract
    from tillvault.plans.session import local_session

    sf_dir, *names = sys.argv[1:]
    spark, db, bad = local_session(), engine(sf_dir), 0
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if name not in sqls or names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = differences(spark, db, query, sqls[name], sf_dir)
        except Exception as error:  # the run goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f}s)", flush=True)
    print(f"{bad} differ")
