"""Compare every query with its SQL: python -m checks.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

import tallyscope as ts
from checks import CHECKS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    check = CHECKS[name]
    df = check.run(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    if check.sql is None:
        return None if got else "no rows"
    result = con.sql(check.sql)
    sql_names, wanted = rows_of(result.columns, result.fetchall())
    if names != sql_names:
        return f"columns {names} != {sql_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    different = [(a, b) for a, b in zip(got, wanted) if a != b]
    if different:
        return f"{len(different)} of {len(got)} rows differ, first {different[0]}"
    kinds = [type(x) for x in (got[0] if got else ())], [type(x) for x in (wanted[0] if got else ())]
    return None if kinds[0] == kinds[1] else f"types {kinds}"


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = ts.session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    bad = 0
    for name in wanted or CHECKS:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - shown, and the run goes on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "rows" if CHECKS[name].sql is None else "sql"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} ({kind}) {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} problems in {len(wanted or CHECKS)} queries")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]) > 0)
