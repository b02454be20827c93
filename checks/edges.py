"""Infinite values, and rows without an identifier in several partitions."""

from __future__ import annotations

import tallyscope as ts
from checks.base import Check, r, read, rounded
from checks.shapes import RELATED, RELATED_COLUMNS, pair_sql, related
from pyspark.sql import functions as F


def infinite_groups(spark, sf):
    """One in 17 event values is infinite; no group can be normal then."""
    value = F.when(F.col("event_id") % 17 == 0, float("inf")).otherwise(F.col("value"))
    events = read(spark, sf, "events").select("event_type", value.alias("value"))
    found = ts.distributions(events, ["event_type"]).select(
        "event_type", "n", "q1", "is_normal", "normality_p_value", "distribution_type"
    )
    return rounded(found, q1=4)


INFINITE_SQL = f"""
    WITH e AS (SELECT event_type,
                 CASE WHEN event_id % 17 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM events)
    SELECT event_type, count(*) AS n, {r('quantile_cont(v, 0.25)', 4)} AS q1,
        NOT bool_or(isinf(v)) AS is_normal, CASE WHEN bool_or(isinf(v)) THEN 0e0 END AS normality_p_value,
        CASE WHEN bool_or(isinf(v)) THEN 'skewed' END AS distribution_type
    FROM e GROUP BY event_type HAVING count(*) >= 30"""


def by_position(spark, sf):
    """The table twice, one copy after the other, so that its rows come in several partitions."""
    events = read(spark, sf, "events").select("value")
    found = ts.outlier_examples(events.unionAll(events))
    return found.select("column", "side", "rank", "row_index", "value")


POSITION_SQL = """
    WITH t AS (SELECT value, row_number() OVER (ORDER BY copy, event_id) - 1 AS place
               FROM events, (SELECT unnest([0, 1]) AS copy)),
    q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t),
    x AS (SELECT place, value, CASE WHEN value < q1 THEN 'low' ELSE 'high' END AS side FROM t, q
          WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
    y AS (SELECT *, row_number() OVER (PARTITION BY side
            ORDER BY CASE WHEN side = 'low' THEN value ELSE -value END, place) AS rank FROM x)
    SELECT 'value' AS "column", side, CAST(rank AS INTEGER) AS rank, place AS row_index, value
    FROM y WHERE rank <= 2"""


def infinite_histogram(spark, sf):
    part = F.col("l_orderkey") % 100
    price = F.when(part == 0, float("inf")).when(part == 1, float("-inf")).otherwise(F.col("l_extendedprice"))
    found = ts.chart_histogram(read(spark, sf, "lineitem").select(price.alias("price")), "price")
    return rounded(found, lower=4, upper=4)


HISTOGRAM_SQL = f"""
    WITH v AS (SELECT CASE l_orderkey % 100 WHEN 0 THEN CAST('inf' AS DOUBLE)
                 WHEN 1 THEN CAST('-inf' AS DOUBLE) ELSE l_extendedprice END AS v FROM lineitem),
    e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM v WHERE NOT isinf(v)),
    b AS (SELECT CASE WHEN NOT isinf(v) THEN least(CAST(floor((v - lo) / w) AS INTEGER), 29)
                   WHEN v > 0 THEN 30 ELSE -1 END AS bin,
            any_value(lo) AS lo, any_value(w) AS w, count(*) AS n FROM v, e GROUP BY 1)
    SELECT bin, CASE WHEN bin < 0 THEN CAST('-inf' AS DOUBLE) ELSE {r('lo + bin * w', 4)} END AS lower,
        CASE WHEN bin > 29 THEN CAST('inf' AS DOUBLE) ELSE {r('lo + (bin + 1) * w', 4)} END AS upper,
        n AS count FROM b"""


CHECKS = {
    "collinearity": Check(
        lambda s, d: ts.collinearity(related(read(s, d, "lineitem"))),
        "SELECT count(*) FILTER (is_collinear) AS collinear_pairs, "
        "coalesce(bool_or(is_collinear), false) AS has_multicollinearity "
        f"FROM ({pair_sql(RELATED, RELATED_COLUMNS)})",
    ),
    "distributions_with_infinity": Check(infinite_groups, INFINITE_SQL),
    "outlier_examples_by_position": Check(by_position, POSITION_SQL),
    "chart_histogram_with_infinity": Check(infinite_histogram, HISTOGRAM_SQL),
}
