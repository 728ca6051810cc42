"""Run queries beside their SQL on DuckDB and report differences.

    python -m harness.compare <sf_dir> [name or prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

from harness.all_cases import CASES, SQL, oracle_text
from harness.cases import BASE_TABLES
from orgpulse.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        return f"{value:.5f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(value) < 1e-5 else f"{value:.5f}".rstrip("0").rstrip(".")
    return str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = CASES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        return None if got else "no rows"
    cursor = con.execute(oracle_text(name))
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns: query only {sorted(set(df.columns) - set(columns))}, sql only {sorted(set(columns) - set(df.columns))}"
    if got != want:
        extra, missing = got - want, want - got
        return f"{sum(got.values())} against {sum(want.values())} rows\n   query: {next(iter(extra), None)}\n   sql:   {next(iter(missing), None)}"
    return None if got else "no rows on either side"


def main() -> int:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    names = [n for n in CASES if not wanted or any(n.startswith(w) for w in wanted)]
    spark = build_session("compare", "local[8]", 8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = differences(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "" if name in SQL else " (rows only)"
        if problem:
            failed += 1
            print(f"FAIL {name}{mark}: {problem}", flush=True)
        else:
            print(f"ok   {name}{mark} {time.time() - start:.1f}s", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
