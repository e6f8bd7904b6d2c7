"""Run registered queries beside their reference SQL and compare names, row counts and values.

As a script: ``python tests/oracle_check.py <sf_dir> [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


TIMES: list[float] = []


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    return value if value is None else f"{type(value).__name__}:{value}"


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    start = time.time()
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    TIMES.append(time.time() - start)
    cur = con.execute(sql)
    want_names, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(got, got_names), _rows(want, want_names)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    if different:
        return f"{len(different)} rows differ in {sorted(got_names)}, first {different[0][0]} != {different[0][1]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = e.oracle_sql()
    failed = 0
    for name, build in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            result = compare(df, con, oracles[name]) if name in oracles else f"no oracle, {df.count()} rows"
        except Exception as error:  # report and go on
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result is not None
        print(f"{name:28s} {time.time() - start:6.2f}s spark {TIMES[-1] if TIMES else 0:5.2f}s {result or 'ok'}", flush=True)
    print("not ok:", failed)
