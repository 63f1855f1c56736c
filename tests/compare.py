"""Compare a registered query with its SQL, row by row.

Run as ``python -m tests.compare <data folder> [query ...]`` for a report with timings.
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _family(name: str) -> str:
    """Type name both engines agree on."""
    names = {
        "bigint": "BIGINT",
        "int": "INTEGER",
        "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP",
    }
    return names.get(name, name.upper())


def differences(rows: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between the two results; empty if they are equal."""
    expected = con.execute(sql)
    wanted_types = {d[0]: str(d[1]) for d in expected.description}
    wanted_rows = expected.fetchall()
    found_types = {f.name: _family(f.dataType.simpleString()) for f in rows.schema}
    order = sorted(wanted_types)
    if sorted(found_types) != order:
        return [f"columns {sorted(found_types)} != {order}"]
    problems = [
        f"type of {c}: {found_types[c]} != {wanted_types[c]}"
        for c in order
        if found_types[c] != wanted_types[c]
    ]
    positions = [list(wanted_types).index(c) for c in order]
    wanted = Counter(tuple(row[i] for i in positions) for row in wanted_rows)
    found = Counter(tuple(row) for row in rows.select(*order).collect())
    if wanted != found:
        problems.append(f"rows {found.total()} found, {wanted.total()} wanted")
        problems += [f"only found: {r}" for r in list((found - wanted))[:3]]
        problems += [f"only wanted: {r}" for r in list((wanted - found))[:3]]
    if not wanted:
        problems.append("no rows")
    return problems


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = oracle_connection(sf_dir), entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            rows = query(spark, sf_dir)
            problems = differences(rows, con, sql[name]) if name in sql else []
            if name not in sql:
                print(f"     {name} has no SQL: {rows.count()} rows")
        except Exception as exc:  # the report goes on with the next query
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", flush=True)
        for problem in problems:
            print("     ", problem)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
