"""Compare registered queries with their SQL oracles: ``python tests/oracle.py <sf_dir> [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [_value(x) for x in v]
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[int, str | None]:
    """The number of rows and what differs, None when nothing does."""
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return len(got), f"{len(a)} rows != {len(b)}: {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            return len(got), f"row {x!r:.600} != {y!r:.600}"
    return len(got), None


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf_dir), 0
    for name in entry.queries():
        if only and not any(name == o or name.startswith(o) for o in only):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            rows, problem = 0, f"{type(e).__name__}: {str(e)[:1200]}"
        if not rows and not problem:
            problem = "no rows"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if name in entry.oracle_sql() else "rows")
        print(f"{mark:5}{name:28}{time.time() - start:7.2f}s {rows:8d} {problem or ''}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
