"""Segments, findings and complete analyses."""

from __future__ import annotations

import tallyscope as ts
from checks.base import Check, r, read, rounded
from pyspark.sql import functions as F

SEGMENTS = ("l_returnflag", "l_linestatus")
FIGURES = ("l_linenumber", "l_quantity")


def segment_cte(source: str, segments, figures, by: str = "") -> str:
    key = f"{by}, " if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {key}{i} AS i, '{s}' AS segment_column, {j} AS j, '{f}' AS kpi_column, "
        f"{s} AS value, sum({f}) AS v, count({f}) AS n FROM {source} WHERE {s} IS NOT NULL "
        f"GROUP BY {key}{s}"
        for i, s in enumerate(segments)
        for j, f in enumerate(figures)
    )
    pair = f"PARTITION BY {key}segment_column, kpi_column"
    return f"""g AS ({parts}),
    k AS (SELECT *, sum(v) OVER ({pair}) AS total, sum(n) OVER ({pair}) AS total_n,
            row_number() OVER ({pair} ORDER BY v DESC, value) AS rank,
            count(*) OVER ({pair}) AS groups FROM g)"""


SEGMENT_SQL = f"""WITH {segment_cte('lineitem', SEGMENTS, FIGURES)}
    SELECT segment_column, kpi_column, value, n AS count, {r('n * 100.0 / total_n', 4)} AS count_pct,
        {r('v', 2)} AS kpi_value, {r('v * 100.0 / total', 4)} AS kpi_contribution_pct,
        CAST(rank AS INTEGER) AS rank FROM k WHERE groups >= 2 AND total <> 0 AND rank <= 10"""


def insight_sql(source: str, segments, figures, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""WITH {segment_cte(source, segments, figures, by)}
    SELECT {key}segment_column, kpi_column, max(value) FILTER (rank = 1) AS top_value,
        {r('max(v) FILTER (rank = 1)', 2)} AS top_kpi,
        max(value) FILTER (rank = groups) AS bottom_value,
        {r('max(v) FILTER (rank = groups)', 2)} AS bottom_kpi,
        {r('sum(pow(v / total, 2))', 6)} AS concentration_index,
        {r('max(v) FILTER (rank = 1) / max(v) FILTER (rank = groups)', 4)} AS performance_spread
    FROM k WHERE groups >= 2 AND total <> 0 GROUP BY {key}segment_column, kpi_column"""


def performance(spark, sf):
    found = ts.segments(read(spark, sf, "lineitem"))
    columns = ["segment_column", "kpi_column", "value", "count", "count_pct", "kpi_value"]
    return rounded(
        found.select(*columns, "kpi_contribution_pct", "rank"),
        count_pct=4, kpi_value=2, kpi_contribution_pct=4,
    )


def insights(df, by=()):
    found = ts.segment_insights(df, by).drop("segment_position", "kpi_position")
    return rounded(found, top_kpi=2, bottom_kpi=2, concentration_index=6, performance_spread=4)


def with_nation(spark, sf):
    orders, customer = read(spark, sf, "orders"), read(spark, sf, "customer")
    return orders.join(
        customer.select("c_custkey", "c_nationkey", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    ).select("c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderstatus", "o_totalprice")


NATION = """(SELECT c_nationkey, c_mktsegment, o_orderpriority, o_orderstatus, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey)"""


def segment_findings(spark, sf):
    """Findings per nation from its segments and outliers."""
    by = ["c_nationkey"]
    t = ts.Table(with_nation(spark, sf), by)
    found = ts.findings({"segment_insights": ts.segment_insights(t)}, by=by)
    return found.select("c_nationkey", "rank", "title", "severity", "category", "score")


FINDING_SQL = f"""
    WITH s AS ({insight_sql(NATION, ['c_mktsegment', 'o_orderpriority', 'o_orderstatus'],
                            ['o_totalprice'], 'c_nationkey')}),
    o AS (SELECT *, CASE segment_column WHEN 'c_mktsegment' THEN 1 WHEN 'o_orderpriority' THEN 2
            ELSE 3 END AS place, top_kpi / bottom_kpi > 2 AS gap FROM s),
    t AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY place) AS nr FROM o),
    f AS (SELECT *, CASE WHEN gap THEN 165 ELSE 115 END AS score FROM t WHERE nr <= 2)
    SELECT c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, nr)
            AS INTEGER) AS rank, 'Segment Performance: ' || segment_column AS title,
        CASE WHEN gap THEN 'warning' ELSE 'info' END AS severity, 'segmentation' AS category,
        CAST(score AS INTEGER) AS score FROM f"""


def findings_by_nation(spark, sf):
    run = ts.analyze(with_nation(spark, sf), by=["c_nationkey"])
    return run["findings"].select("c_nationkey", "rank", "title", "severity", "category", "score")


def full_run(depth, table):
    def run(spark, sf):
        found = ts.analyze(read(spark, sf, table), depth)["findings"]
        return found.select("rank", "title", "body", "severity", "category", "score", "source_key")

    return run


CHECKS = {
    "segment_performance": Check(performance, SEGMENT_SQL),
    "segment_insights": Check(
        lambda s, d: insights(read(s, d, "lineitem")), insight_sql("lineitem", SEGMENTS, FIGURES)
    ),
    "segment_insights_by": Check(
        lambda s, d: insights(with_nation(s, d), ["c_nationkey"]),
        insight_sql(
            NATION, ["c_mktsegment", "o_orderpriority", "o_orderstatus"], ["o_totalprice"],
            "c_nationkey",
        ),
    ),
    "findings_segments_ranked": Check(segment_findings, FINDING_SQL),
    "findings_ranked": Check(findings_by_nation),
    "analyze_quick": Check(full_run("quick", "orders")),
    "analyze_standard": Check(full_run("standard", "lineitem")),
}
