"""Compare registered queries with their SQL twins: python tests/check_oracles.py [sf] [names]."""

from __future__ import annotations

import importlib.util
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load_entry():
    """Import the driver contract."""
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def connect(folder: str):
    """Open an in-memory database with the tables as views."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """Make values of both engines comparable."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canonical(columns, rows):
    """Sort columns by name and rows by text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def kind(name: str) -> str:
    """Fold type names of both engines into families."""
    name = name.lower()
    for family, words in {
        "int": ("bigint", "integer", "int", "long", "smallint"),
        "float": ("double", "float"),
        "text": ("varchar", "string"),
        "bool": ("boolean",),
        "time": ("timestamp",),
    }.items():
        if any(name.startswith(w) for w in words):
            return family
    return name


def compare(spark, con, name, build, sql, folder):
    """Return None on a match, else what differs."""
    df = build(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None, len(rows)
    found = con.execute(sql)
    want_columns = [d[0] for d in found.description]
    want = found.fetchall()
    described = con.execute("DESCRIBE " + sql).fetchall()
    types = {d[0]: str(d[1]) for d in described}
    for column, dtype in df.dtypes:
        if column in types and kind(dtype) != kind(types[column]):
            return f"type of {column}: {dtype} vs {types[column]}", len(rows)
    a, b = canonical(df.columns, rows), canonical(want_columns, want)
    if a[0] != b[0]:
        return f"columns {a[0]} vs {b[0]}", len(rows)
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} vs {len(b[1])}", len(rows)
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}", len(rows)
    return None, len(rows)


def main() -> int:
    """Run the comparison and print one line per query."""
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    entry = load_entry()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, build in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem, rows = compare(spark, con, name, build, oracles.get(name), folder)
        except Exception as error:  # report and go on
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", 0
            if "-v" in sys.argv:
                traceback.print_exc()
        mark = "ok  " if problem is None else "FAIL"
        if name not in oracles and problem is None:
            mark = "rows"
        failed += problem is not None
        print(f"{mark} {name} rows={rows} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"failed={failed} queries={len(queries)} oracles={len(oracles)}")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
