"""Run queries beside their SQL and compare the rows: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR"}


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(row[i] for i in order) for row in rows), [names[i] for i in order]


def compare(spark: SparkSession, con, sf: str, name: str) -> tuple[bool, str]:
    begun = time.monotonic()
    df = QUERIES[name](spark, sf)
    got, got_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.monotonic() - begun
    if name not in ORACLE:
        return True, f"rows only: {sum(got.values())} ({took:.1f}s)"
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want, want_names = _rows(names, cursor.fetchall())
    types = dict(df.dtypes)
    sql_types = {d[0]: str(d[1]) for d in cursor.description}
    odd = {c: (t, sql_types.get(c)) for c, t in types.items() if SQL_TYPES.get(t) != sql_types.get(c)}
    if odd and got_names == want_names:
        return False, f"types differ: {odd}"
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if got != want:
        extra, missing = got - want, want - got
        return False, (
            f"{sum(got.values())} vs {sum(want.values())} rows, {sum(extra.values())} differ\n"
            f"   spark {str(next(iter(extra), None))[:600]}\n"
            f"   sql   {str(next(iter(missing), None))[:600]}\n   {types}"
        )
    return True, f"{sum(got.values())} rows ({took:.1f}s)"


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for name in names:
        try:
            ok, told = compare(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001
            ok, told = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "BAD ", name, told, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
