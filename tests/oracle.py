"""Compare registered queries with their DuckDB oracles.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return "decimal:" + str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if value is None else str(value)


def kind(value):
    return type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(str(plain(r[i])) for i in order) for r in rows)
    ), [names[i] for i in order]


def compare(spark, con, name, build, sql, sf_dir):
    """Returns (ok, message)."""
    result = build(spark, sf_dir)
    found, found_names = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if sql is None:
        return len(found) > 0, f"{len(found)} rows, no oracle"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    raw = cursor.fetchall()
    expected, expected_names = rows_of(names, raw)
    if found_names != expected_names:
        return False, f"columns {found_names} != {expected_names}"
    types = {d[0]: str(d[1]) for d in cursor.description}
    for field in result.schema.fields:
        simple, duck = field.dataType.simpleString(), types[field.name]
        ok = {
            "bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR", "JSON"),
            "boolean": ("BOOLEAN",), "float": ("FLOAT",),
        }.get(simple, ())
        if duck not in ok:
            return False, f"type of {field.name}: {simple} != {duck}"
    if found != expected:
        only_found = [r for r in found if r not in set(expected)][:3]
        only_expected = [r for r in expected if r not in set(found)][:3]
        return False, (
            f"{len(found)} vs {len(expected)} rows {found_names}\n   spark  {only_found}\n   oracle {only_expected}"
        )
    return True, f"{len(found)} rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from logloom.session import get_session

    spark = get_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                        spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        started = time.time()
        try:
            ok, message = compare(spark, con, name, queries[name], oracles.get(name), args.sf)
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - started:.1f}s {message}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
