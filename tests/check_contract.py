"""Compare every contract query with its SQL oracle in DuckDB.

    python tests/check_contract.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry_module  # noqa: E402


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall(), [str(d[1]) for d in found.description]


def compare(spark, sf_dir, name):
    """A line of text about one query, and whether it agrees."""
    start = time.time()
    df = entry_module.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = f"{time.time() - start:.1f}s"
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {name}: {len(rows)} rows {took}", len(rows) > 0
    columns, expected, types = oracle(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {name}: {df.columns} / {columns}", False
    left, right = canonical(df.columns, rows), canonical(columns, expected)
    if left != right:
        differing = [p for p in zip(left, right) if p[0] != p[1]][:3]
        return f"VALUES {name}: {len(left)} / {len(right)} rows {differing} {types}", False
    return f"ok {name}: {len(rows)} rows {took}", True


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="check-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(entry_module.queries())
    failed = 0
    for name in names:
        line, good = compare(spark, sf_dir, name)
        failed += not good
        print(line, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    sys.exit(failed > 0)
