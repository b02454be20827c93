"""Missing values, duplicates, constants, scores."""

from __future__ import annotations

import tallyscope as ts
from checks.base import GAPPY, LINEITEM, Check, gappy, r, rounded
from pyspark.sql import functions as F

NARROW = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"]


def missing_sql(source: str, columns, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {key}{i} AS position, '{c}' AS col, count(*) AS total, count({c}) AS n, "
        f"count(DISTINCT {c}) <= 1 AS same FROM {source}{group}"
        for i, c in columns
    ]
    return f"""SELECT {key}CAST(position AS INTEGER) AS position, col AS "column",
        total - n AS missing_count, {r('(total - n) * 100.0 / total', 4)} AS missing_pct,
        (total - n) * 100.0 / total > 5 AS is_flagged, same AS is_constant
    FROM ({" UNION ALL ".join(parts)})"""


def narrow(spark, sf):
    """Few columns of lineitem with gaps, a constant and an empty column: many copies."""
    return gappy(spark, sf).select(
        *NARROW, F.lit("x").alias("fixed"), F.lit(None).cast("double").alias("empty")
    )


NARROW_SQL = f"(SELECT {', '.join(NARROW)}, 'x' AS fixed, CAST(NULL AS DOUBLE) AS empty FROM {GAPPY})"


def quality_sql(source: str, columns, by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    missing = " + ".join(f"(count(*) - count({c}))" for c in columns)
    constant = " + ".join(f"CAST(count(DISTINCT {c}) <= 1 AS BIGINT)" for c in columns)
    k = len(columns)
    distinct = f"SELECT {key}count(*) AS d FROM (SELECT DISTINCT * FROM {source}){group}"
    join = f"a JOIN b USING ({by})" if by else "a, b"
    return f"""
    WITH a AS (SELECT {key}count(*) AS n, {missing} AS missing, count(*) FILTER ({full}) AS whole,
                 {constant} AS constant FROM {source}{group}),
    b AS ({distinct}),
    c AS (SELECT *, n - d AS copies, missing * 100.0 / (n * {k}) AS missing_pct,
            whole * 100.0 / n AS complete FROM {join})
    SELECT {key}{r(f'''0.35 * (1 - missing_pct / 100) + 0.35 * complete / 100
        + 0.15 * greatest(0, 1 - copies * 100.0 / n / 100 * 10)
        + 0.15 * (1 - constant / {k}.0)''', 4)} AS overall_score,
        CAST(missing AS BIGINT) AS total_missing_cells, n * {k} AS total_cells,
        {r('missing_pct', 4)} AS missing_pct, {r('complete', 4)} AS complete_rows_pct,
        copies AS duplicate_rows, CAST(constant AS INTEGER) AS constant_columns,
        CAST(complete < 80 AS INTEGER) + CAST(copies * 100.0 / n > 1 AS INTEGER)
          + CAST(constant > 0 AS INTEGER) + 1 AS warnings
    FROM c"""  # the empty column always gives the warning about missing values


def quality(df, by=()):
    found = ts.table_quality(df, by).withColumn("warnings", F.size("warnings"))
    return rounded(found, overall_score=4, missing_pct=4, complete_rows_pct=4)


CHECKS = {
    "missing_by_column": Check(
        lambda s, d: rounded(ts.column_quality(gappy(s, d)), missing_pct=4),
        missing_sql(GAPPY, list(enumerate(LINEITEM))),
    ),
    "missing_by_column_by": Check(
        lambda s, d: rounded(ts.column_quality(gappy(s, d), ["l_linestatus"]), missing_pct=4),
        missing_sql(
            GAPPY,
            [(i, c) for i, c in enumerate(LINEITEM) if c != "l_linestatus"],
            "l_linestatus",
        ),
    ),
    "table_quality": Check(
        lambda s, d: quality(narrow(s, d)), quality_sql(NARROW_SQL, [*NARROW, "fixed", "empty"])
    ),
    "table_quality_by": Check(
        lambda s, d: quality(narrow(s, d), ["l_linestatus"]),
        quality_sql(
            NARROW_SQL,
            [c for c in [*NARROW, "fixed", "empty"] if c != "l_linestatus"],
            "l_linestatus",
        ),
    ),
    "duplicate_rows": Check(
        lambda s, d: ts.duplicate_rows(narrow(s, d)),
        f"SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows "
        f"FROM (SELECT DISTINCT * FROM {NARROW_SQL})",
    ),
    "constant_columns": Check(
        lambda s, d: ts.constant_columns(narrow(s, d)).select("column"),
        f"""SELECT "column" FROM ({missing_sql(NARROW_SQL, list(enumerate([*NARROW, 'fixed', 'empty'])))})
        WHERE is_constant""",
    ),
}
