"""Runs registered queries beside their SQL and compares schema, row count and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SQL_SECONDS: list[float] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, build, sql: str) -> str:
    """'' if equal, else what differs."""
    df = build(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    SQL_SECONDS.append(time.time() - started)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = _rows(df.columns, ours), _rows(columns, theirs)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        parts = [(c, p[:80], q[:80]) for c, p, q in zip(sorted(columns), x, y) if p != q]
        return f"{len(wrong)} of {len(a)} rows differ, first: {parts[:4]}"
    return ""


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from riskweave.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name, build in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, build, oracles[name])
                note = "equal" if not problem else "DIFFERS " + problem
                n = f"sql {SQL_SECONDS[-1]:5.2f}s" if SQL_SECONDS else ""
            else:
                n = build(spark, sf_dir).count()
                problem, note = "", "rows only"
        except Exception as error:  # noqa: BLE001
            problem = note = f"ERROR {type(error).__name__}: {str(error)[:700]}"
            n = ""
        failures += bool(problem)
        print(f"{name:34s} {time.time() - started:6.2f}s {n} {note}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(min(main(), 1))
