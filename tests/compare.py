"""Run registered queries on Spark and their SQL on DuckDB, and compare rows, order-insensitively."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(f"{value:.12g}") + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "hugeint": "int128", "integer": "int",
    "double": "double", "float": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date",
    "timestamp": "timestamp", "timestamp_ntz": "timestamp",
}


def kind(name: str) -> str:
    name = str(name).lower()
    return KINDS.get(name, name)


def compare(spark, con, query, sf_dir: str) -> str:
    """Empty text when both sides agree, else what differs."""
    frame = query.run(spark, sf_dir)
    left_names = frame.columns
    left = [tuple(row) for row in frame.collect()]
    if query.sql is None:
        return "" if left else "no rows (and no SQL)"
    result = con.execute(query.sql)
    right_names = [d[0] for d in result.description]
    right_types = {d[0]: kind(d[1]) for d in result.description}
    right = result.fetchall()
    if sorted(left_names) != sorted(right_names):
        return f"columns differ: {sorted(left_names)} vs {sorted(right_names)}"
    left_types = {f.name: kind(f.dataType.simpleString()) for f in frame.schema.fields}
    types = {n: (left_types[n], right_types[n]) for n in left_names if left_types[n] != right_types[n]}
    order = sorted(left_names)
    left_rows = sorted((tuple(plain(r[left_names.index(n)]) for n in order) for r in left), key=repr)
    right_rows = sorted((tuple(plain(r[right_names.index(n)]) for n in order) for r in right), key=repr)
    if len(left_rows) != len(right_rows):
        return f"{len(left_rows)} rows vs {len(right_rows)}; {left_rows[:2]} vs {right_rows[:2]}"
    for a, b in zip(left_rows, right_rows):
        if a != b:
            diff = [(n, x, y) for n, x, y in zip(order, a, b) if x != y]
            return f"values differ: {diff[:6]}\n    row {a}"
    if types:
        return f"types differ: {types}"
    return "" if left_rows else "no rows"


def main(argv: list[str]) -> None:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import comptoir.registry.all  # noqa: F401
    from comptoir.registry.base import REGISTRY
    from comptoir.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = [n for n in REGISTRY if not argv or any(n.startswith(a) for a in argv)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, REGISTRY[name], sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        if problem:
            bad += 1
        print(f"{'ok ' if not problem else 'BAD'} {took:6.2f}s {name} {'' if REGISTRY[name].sql else '(rows only) '}{problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main(sys.argv[1:])
