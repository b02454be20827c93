"""Chart tables."""

from __future__ import annotations

import tallyscope as ts
from checks.base import Check, r, read, rounded
from pyspark.sql import functions as F


def dated(df, digits=2):
    return rounded(df.withColumn("x", F.to_date("x")), y=digits)


def histogram(spark, sf):
    found = ts.chart_histogram(read(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(found, lower=4, upper=4)


HISTOGRAM_SQL = f"""
    WITH e AS (SELECT min(l_extendedprice) AS lo,
                 (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
    b AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INTEGER), 29) AS bin,
            any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT bin, {r('lo + bin * w', 4)} AS lower, {r('lo + (bin + 1) * w', 4)} AS upper,
        n AS count FROM b"""


def scatter_invariants(spark, sf):
    """The sample has the right size and only holds pairs of the table."""
    lineitem = read(spark, sf, "lineitem")
    points = ts.chart_scatter(lineitem, "l_quantity", "l_extendedprice")
    pairs = lineitem.select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    known = points.join(pairs.distinct(), ["x", "y"], "left_semi")
    return known.agg(F.count(F.lit(1)).alias("points"))


CHECKS = {
    "chart_line": Check(
        lambda s, d: dated(
            ts.chart_line(
                read(s, d, "orders").withColumn("third", F.col("o_totalprice") / 3),
                "o_orderdate",
                "third",
                "mean",
            ),
            5,
        ),
        f"SELECT CAST(o_orderdate AS DATE) AS x, {r('avg(o_totalprice / 3)', 5)} AS y "
        "FROM orders GROUP BY 1",
    ),
    "chart_line_monthly": Check(
        lambda s, d: dated(
            ts.chart_line(read(s, d, "events"), "ts", "value", "sum", grain="monthly")
        ),
        f"SELECT last_day(ts) AS x, {r('sum(value)', 2)} AS y FROM events GROUP BY 1",
    ),
    "chart_line_raw": Check(
        lambda s, d: ts.chart_line(read(s, d, "events"), "event_id", "value", "none"),
        "SELECT event_id AS x, value AS y FROM events",
    ),
    "chart_area": Check(
        lambda s, d: dated(ts.chart_area(read(s, d, "lineitem"), "l_shipdate", "l_quantity")),
        f"SELECT CAST(l_shipdate AS DATE) AS x, {r('sum(l_quantity)', 2)} AS y "
        "FROM lineitem GROUP BY 1",
    ),
    "chart_bar_top15": Check(
        lambda s, d: rounded(ts.chart_bar(read(s, d, "orders"), "o_custkey", "o_totalprice"), y=2),
        f"SELECT o_custkey AS x, {r('sum(o_totalprice)', 2)} AS y FROM orders GROUP BY 1 "
        "ORDER BY sum(o_totalprice) DESC, 1 LIMIT 15",
    ),
    "chart_bar_counts": Check(
        lambda s, d: ts.chart_bar(read(s, d, "part"), "p_brand"),
        "SELECT p_brand AS x, count(*) AS y FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    ),
    "chart_donut_top10": Check(
        lambda s, d: rounded(
            ts.chart_donut(read(s, d, "part"), "p_brand", "p_retailprice", "mean"), y=4
        ),
        f"SELECT p_brand AS x, {r('avg(p_retailprice)', 4)} AS y FROM part GROUP BY 1 "
        "ORDER BY avg(p_retailprice) DESC, 1 LIMIT 10",
    ),
    "chart_histogram": Check(histogram, HISTOGRAM_SQL),
    "chart_scatter_sample": Check(
        lambda s, d: ts.chart_scatter(read(s, d, "lineitem"), "l_quantity", "l_extendedprice")
    ),
    "chart_scatter_size": Check(
        scatter_invariants,
        "SELECT least(count(*), 1000) AS points FROM lineitem "
        "WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
    ),
    "metric_comparison": Check(
        lambda s, d: rounded(ts.metric_comparison(read(s, d, "lineitem")), value=4),
        " UNION ALL ".join(
            f"SELECT '{c}' AS metric, {r(f'avg({c})', 4)} AS value FROM lineitem "
            f"HAVING count(DISTINCT {c}) <= 0.8 * count(*)"
            for c in ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
        ),
    ),
}
