"""Compare registered queries with their oracle SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def spark_session(cpus: str = "8"):
    from pyspark.sql import SparkSession
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("evtlake")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6g}" if value else "0"
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 1_000_000 else str(value)
    return str(value)


def compare(spark, name: str, sf_dir: str, queries: dict, oracles: dict) -> tuple[str, int, float]:
    began = time.time()
    df = queries[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if name not in oracles:
        return "rows only", len(rows), took
    names, expected = oracle_rows(sf_dir, oracles[name])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows), took
    order = sorted(names)
    mine = sorted(tuple(r[df.columns.index(c)] for c in order) for r in map(lambda t: tuple(map(normal, t)), rows))
    theirs = sorted(tuple(r[names.index(c)] for c in order) for r in map(lambda t: tuple(map(normal, t)), expected))
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}", len(rows), took
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} rows differ {order}: {bad[0][0]} != {bad[0][1]}", len(rows), took
    return "ok", len(rows), took


def main() -> None:
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = spark_session()
    failed = 0
    for name in sys.argv[2:] or queries:
        try:
            outcome, n, took = compare(spark, name, sf_dir, queries, oracles)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            outcome, n, took = f"error {type(e).__name__}: {str(e)[:600]}", 0, 0.0
        failed += outcome not in ("ok", "rows only")
        print(f"{name:28s} {n:8d} {took:7.2f}s {outcome}", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
