"""Run every query beside its SQL and compare columns, rows and values.

    python check_oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from martlens.session import build_session
from martlens.testbed.bindings import TABLES
from martlens.testbed.catalog import ORACLE, QUERIES


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, con):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    if len(set(df.columns)) < len(df.columns):
        return 0.0, f"REPEATED COLUMN NAMES {df.columns}"
    mine = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in ORACLE:
        return took, f"rows only ({len(mine)})"
    result = con.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return took, f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    if len(mine) != len(theirs):
        return took, f"ROWS {len(mine)} vs {len(theirs)}"
    different = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    if different:
        return took, f"VALUES {len(different)} of {len(mine)}: {different[:2]}"
    return took, f"ok ({len(mine)})"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8",
                   "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        try:
            took, verdict = compare(spark, sf_dir, name, con)
        except Exception as error:  # report and go on with the next query
            took, verdict = 0.0, f"ERROR {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{took:7.2f}s  {name:24s} {verdict}", flush=True)
    print(f"{bad} problems")
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
