"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, dates as text, in sorted order."""
    columns = sorted(frame.columns)

    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return None
        if hasattr(value, "isoformat"):
            return value.isoformat()[:10]
        if hasattr(value, "item"):
            return value.item()
        return value

    rows = [tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def differences(spark_rows: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    ours = spark_rows.toPandas()
    theirs = con.execute(sql).df()
    found = []
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"]
    for column in sorted(ours.columns):
        kinds = str(ours[column].dtype), str(theirs[column].dtype)
        if kinds[0] != kinds[1] and "datetime" not in kinds[1] and "str" not in kinds[1]:
            found.append(f"{column}: type {kinds[0]} != {kinds[1]}")
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        found.append(f"rows {len(a)} != {len(b)}")
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}")
    return found


def main(folder: str, names: list[str]) -> int:
    from hubloom.session import build_session
    from checks.oracle_sql import all_oracles
    from hubloom.plans.catalog import QUERIES

    spark = build_session("compare", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false",
                          spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), all_oracles(), 0
    for name in names or QUERIES:
        started = time.time()
        try:
            result = QUERIES[name](spark, folder)
            if name in sql:
                problems = differences(result, con, sql[name])
                state = "; ".join(problems) or "match"
            else:
                problems, state = [], f"{result.count()} rows"
        except Exception as error:  # a broken query must not hide the others
            problems = [repr(error)[:600]]
            state = problems[0]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {time.time() - started:6.2f}s  {state}", flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    sys.exit(main(arguments[0] if arguments else "/root/testdata/sf0.01", arguments[1:]))
