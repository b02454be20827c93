"""Grain, period series, trends, seasonality."""

from __future__ import annotations

import tallyscope as ts
from checks.base import Check, r, read, rounded, with_t_tail
from pyspark.sql import functions as F

GRAIN = """CASE WHEN d <= 1.5 THEN 'daily' WHEN d <= 8 THEN 'weekly' WHEN d <= 35 THEN 'monthly'
    WHEN d <= 100 THEN 'quarterly' ELSE 'yearly' END"""


def grain_sql(source: str, column: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    over = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
    WITH g AS (SELECT {key}{column} AS t, epoch({column} - lag({column}) OVER (
                 {over}ORDER BY {column})) / 86400 AS gap FROM {source}),
    m AS (SELECT {key}count(t) AS n, quantile_cont(gap, 0.5) AS d FROM g{group})
    SELECT {key}n, {GRAIN} AS grain FROM m WHERE n >= 2"""


def months(spark, sf, unit):
    """One row per month, quarter or week of orders."""
    orders = read(spark, sf, "orders")
    return orders.groupBy(F.to_date(F.date_trunc(unit, "o_orderdate")).alias("start")).agg(
        F.sum("o_totalprice").alias("total")
    )


def month_source(unit: str) -> str:
    return (
        f"(SELECT CAST(date_trunc('{unit}', o_orderdate) AS TIMESTAMP) AS start, "
        f"sum(o_totalprice) AS total FROM orders GROUP BY 1)"
    )


PERIODS = {
    "daily": ("date_trunc('day', {d})", "1 day", "s"),
    "weekly": ("date_trunc('week', {d})", "7 days", "s + INTERVAL 6 DAY"),
    "monthly": ("date_trunc('month', {d})", "1 month", "last_day(s)"),
    "quarterly": ("date_trunc('quarter', {d})", "3 months", "last_day(s + INTERVAL 2 MONTH)"),
    "yearly": ("date_trunc('year', {d})", "1 year", "last_day(s + INTERVAL 11 MONTH)"),
}


def series_cte(grain: str, source: str, date: str, metric: str) -> str:
    start, step, end = PERIODS[grain]
    start = start.format(d=date)
    return f"""
    p AS (SELECT CAST({start} AS TIMESTAMP) AS s, sum({metric}) AS v FROM {source}
          WHERE {metric} IS NOT NULL GROUP BY 1),
    c AS (SELECT unnest(generate_series((SELECT min(s) FROM p), (SELECT max(s) FROM p),
            INTERVAL {step})) AS s),
    y AS (SELECT CAST(row_number() OVER (ORDER BY c.s) - 1 AS INTEGER) AS x,
            CAST({end.replace('s', 'c.s', 1) if end == 's' else end.replace('s +', 'c.s +').replace('(s', '(c.s')} AS DATE)
              AS period, coalesce(v, 0) AS value FROM c LEFT JOIN p ON c.s = p.s)"""


def series(spark, sf, grain):
    """Orders above half a million only, so that some periods are empty."""
    orders = read(spark, sf, "orders").withColumn(
        "big", F.when(F.col("o_totalprice") > 490000, F.col("o_totalprice"))
    )
    found = ts.period_series(orders, "o_orderdate", ["big"], grain)
    return rounded(found.select("metric", "x", "period", "value"), value=2)


BIG = "(SELECT o_orderdate, CASE WHEN o_totalprice > 490000 THEN o_totalprice END AS big FROM orders)"


def series_sql(grain: str) -> str:
    return f"""WITH {series_cte(grain, BIG, 'o_orderdate', 'big')}
    SELECT 'big' AS metric, x, period, {r('value', 2)} AS value FROM y"""


def trend(spark, sf):
    found = ts.trends(
        read(spark, sf, "orders"), metrics=["o_totalprice"], grain="monthly"
    ).select("metric", F.col("periods"), "slope", "slope_pct")
    return rounded(found, slope=5, slope_pct=6)


TREND_SQL = f"""WITH {series_cte('monthly', 'orders', 'o_orderdate', 'o_totalprice')}
    SELECT 'o_totalprice' AS metric, count(*) AS periods, {r('regr_slope(value, x)', 5)} AS slope,
        {r('regr_slope(value, x) / avg(value) * 100', 6)} AS slope_pct FROM y"""


def fit_sql(grain: str, metric: str) -> str:
    return f"""(WITH {series_cte(grain, 'orders', 'o_orderdate', metric)}
    SELECT '{grain}' AS grain, '{metric}' AS metric, regr_slope(value, x) AS slope, count(*) - 2e0 AS v,
        sqrt(regr_r2(value, x) * (count(*) - 2) / (1 - regr_r2(value, x))) AS t FROM y)"""


FITS = " UNION ALL ".join(fit_sql(g, m) for g in PERIODS for m in ("o_orderkey", "o_custkey", "o_totalprice"))
TREND_T = f"SELECT f.* FROM ({FITS}) f JOIN ({grain_sql('orders', 'o_orderdate')}) g ON f.grain = g.grain"
SIGNIFICANCE_SQL = f"""SELECT metric, CASE WHEN p > 0.05 THEN 'stable' WHEN slope > 0 THEN 'increasing'
        ELSE 'decreasing' END AS direction, {r('p', 6)} AS p_value
    FROM ({with_t_tail(TREND_T, ["metric", "slope"])})"""


def change(spark, sf):
    found = ts.trends(read(spark, sf, "orders"), metrics=["o_totalprice"], grain="quarterly")
    columns = ["current_period", "previous_period", "current_value", "previous_value", "change_pct"]
    return rounded(found.select("metric", *columns), current_value=2, previous_value=2, change_pct=4)


CHANGE_SQL = f"""WITH {series_cte('quarterly', 'orders', 'o_orderdate', 'o_totalprice')},
    l AS (SELECT *, lag(period) OVER (ORDER BY x) AS pp, lag(value) OVER (ORDER BY x) AS pv FROM y)
    SELECT 'o_totalprice' AS metric, CAST(period AS VARCHAR) AS current_period,
        CAST(pp AS VARCHAR) AS previous_period, {r('value', 2)} AS current_value,
        {r('pv', 2)} AS previous_value, {r('(value - pv) / pv * 100', 4)} AS change_pct
    FROM l ORDER BY x DESC LIMIT 1"""


def trend_by(spark, sf):
    """Grain is detected per customer, so periods differ between customers."""
    found = ts.trends(
        read(spark, sf, "orders"), by=["o_custkey"], metrics=["o_totalprice"], date_col="o_orderdate"
    )
    return rounded(
        found.select("o_custkey", "periods", "slope", "current_value"), slope=5, current_value=2
    )


TREND_BY_SQL = f"""
    WITH g AS ({grain_sql('orders', 'o_orderdate', 'o_custkey')}),
    b AS (SELECT o.o_custkey, grain, CASE grain WHEN 'daily' THEN date_trunc('day', o_orderdate)
            WHEN 'weekly' THEN date_trunc('week', o_orderdate)
            WHEN 'monthly' THEN date_trunc('month', o_orderdate)
            WHEN 'quarterly' THEN date_trunc('quarter', o_orderdate)
            ELSE date_trunc('year', o_orderdate) END AS s, o_totalprice AS v
          FROM orders o JOIN g ON o.o_custkey = g.o_custkey),
    p AS (SELECT o_custkey, grain, s, sum(v) AS v FROM b GROUP BY ALL),
    i AS (SELECT *, CASE grain WHEN 'daily' THEN date_diff('day', s0, s)
            WHEN 'weekly' THEN date_diff('day', s0, s) // 7
            WHEN 'monthly' THEN date_diff('month', s0, s)
            WHEN 'quarterly' THEN date_diff('month', s0, s) // 3
            ELSE date_diff('year', s0, s) END AS x
          FROM (SELECT *, min(s) OVER (PARTITION BY o_custkey) AS s0 FROM p)),
    e AS (SELECT o_custkey, max(x) + 1 AS k, sum(v) AS sy, sum(x * v) AS sxy,
            arg_max(v, x) AS last FROM i GROUP BY o_custkey)
    SELECT o_custkey, k AS periods, {r('''CASE WHEN k < 3 THEN 0 ELSE
            (sxy - (k - 1) / 2.0 * sy) / (k * (k * k - 1) / 12.0) END''', 5)} AS slope,
        {r('last', 2)} AS current_value FROM e WHERE k >= 2"""


def seasonal(spark, sf):
    """Order totals, five-fold in December."""
    orders = read(spark, sf, "orders")
    december = F.when(F.month("o_orderdate") == 12, 5).otherwise(1)
    return orders.select((F.col("o_totalprice") * december).alias("total"), "o_orderdate")


SEASON_SQL = f"""
    WITH m AS (SELECT month(o_orderdate) AS m, avg(o_totalprice
                 * CASE WHEN month(o_orderdate) = 12 THEN 5 ELSE 1 END) AS v
               FROM orders GROUP BY 1),
    d AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders),
    s AS (SELECT stddev_samp(v) / avg(v) * 100 AS cv FROM m)
    SELECT 'o_orderdate' AS date_column, grain AS detected_grain, CAST(a AS DATE) AS start,
        CAST(b AS DATE) AS "end", CAST(floor(epoch(b - a) / 86400) AS INTEGER) AS span_days,
        cv > 20 AS seasonality_detected, CASE WHEN cv > 20 THEN 'Dec typically highest' END AS pattern,
        {r('CASE WHEN cv > 20 THEN cv ELSE 0 END', 4)} AS cv
    FROM s, d, ({grain_sql('orders', 'o_orderdate')})"""


CHECKS = {
    "time_grain_orders": Check(
        lambda s, d: ts.time_grain(read(s, d, "orders")).select("n", "grain"),
        grain_sql("orders", "o_orderdate"),
    ),
    "time_grain_events": Check(
        lambda s, d: ts.time_grain(read(s, d, "events")).select("n", "grain"),
        grain_sql("events", "ts"),
    ),
    "time_grain_months": Check(
        lambda s, d: ts.time_grain(months(s, d, "month")).select("n", "grain"),
        grain_sql(month_source("month"), "start"),
    ),
    "time_grain_weeks": Check(
        lambda s, d: ts.time_grain(months(s, d, "week")).select("n", "grain"),
        grain_sql(month_source("week"), "start"),
    ),
    "time_grain_by": Check(
        lambda s, d: ts.time_grain(read(s, d, "orders"), by=["o_custkey"]).select(
            "o_custkey", "n", "grain"
        ),
        grain_sql("orders", "o_orderdate", "o_custkey"),
    ),
    **{
        f"period_series_{g}": Check(lambda s, d, g=g: series(s, d, g), series_sql(g))
        for g in PERIODS
    },
    "trend_ols": Check(trend, TREND_SQL),
    "trend_by": Check(trend_by, TREND_BY_SQL),
    "period_over_period": Check(change, CHANGE_SQL),
    "trend_significance": Check(
        lambda s, d: ts.trends(read(s, d, "orders")).select(
            "metric", "direction", F.round("p_value", 6).alias("p_value")
        ),
        SIGNIFICANCE_SQL,
    ),
    "time_profile_seasonal": Check(
        lambda s, d: rounded(ts.time_profile(seasonal(s, d)), cv=4), SEASON_SQL
    ),
    "seasonality": Check(
        lambda s, d: rounded(ts.seasonality(read(s, d, "events"), metric="value"), cv=4),
        f"""WITH m AS (SELECT month(ts) AS m, avg(value) AS v FROM events GROUP BY 1)
        SELECT count(*) AS months, {r('stddev_samp(v) / avg(v) * 100', 4)} AS cv,
            ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']
                [CAST(arg_max(m, v) AS INTEGER)] AS peak_month FROM m""",
    ),
}
