"""Shape of numeric columns: quantiles, kurtosis, normality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import distribution_label, finite_or, is_finite, kurtosis_label
from tallyscope.functions.probability import (
    dagostino_p,
    normal_quantile,
    normal_upper_tail,
    polynomial,
)
from tallyscope.plans import quantiles as q
from tallyscope.plans.moments import fact
from tallyscope.plans.table import Table, field, join_on, quoted, table, unpivoted, with_group_values

# Royston (1995), algorithm AS R94, lowest power first.
LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
LOG_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LOG_SD = (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(df: DataFrame | Table, by: Sequence[str] = ()) -> DataFrame:
    """(keys, column, n, w, p) for columns with 30 to 4,999 differing values.

    Larger groups are filtered out before anything is sorted, so a window never holds
    more than 4,999 rows.
    """
    t = table(df, by)
    schema = "column string, n bigint, w double, p double"
    columns = t.numeric
    if not columns:
        return t.df.select(*t.keys, *[F.lit(None).cast(k).alias(n) for n, k in (c.split() for c in schema.split(", "))]).where(F.lit(False))
    wanted = dict(fact("n", t, c) for c in columns)
    counts = t.facts(wanted).select(*t.keys, F.array(*[F.col(n).cast("double") for n in wanted]).alias("counts"))
    if not t.by:
        n = counts.first()["counts"] if columns else []
        columns = [
            c for c, k in zip(columns, n) if rules.MIN_SHAPE <= k < rules.SHAPIRO_LIMIT
        ]
        if not columns:
            return t.spark.createDataFrame([], schema)
        rows = t.df
    else:
        rows = with_group_values(t, t.df, counts)

    def small_enough(c: str) -> str:
        value = f"CAST({quoted(c)} AS DOUBLE)"
        if not t.by:
            return value
        size = f"counts[{t.numeric.index(c)}]"
        return f"IF({size} >= {rules.MIN_SHAPE} AND {size} < {rules.SHAPIRO_LIMIT}, {value}, NULL)"

    values = rows.select(*t.keys, unpivoted(t, columns, small_enough)).where("value is not null")
    group = Window.partitionBy(*t.keys, "column")
    x, n, i, m = F.col("value"), F.col("n"), F.col("i"), F.col("m")
    scored = (
        values.withColumn("n", F.count(F.lit(1)).over(group))
        .withColumn("i", F.row_number().over(group.orderBy("value")))
        .withColumn("m", normal_quantile("((i - 0.375D) / (n + 0.25D))"))
    )
    inner = (i > 2) & (i < n - 1)

    def at(place: Column, value: Column) -> Column:
        return F.max(F.when(i == place, value))

    sums = scored.groupBy(*t.keys, "column", "n").agg(
        F.sum(m * m).alias("mm"),
        F.sum(F.when(inner, m * x)).alias("mx"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("ss"),
        at(n, m).alias("m_last"),
        at(n - 1, m).alias("m_next"),
        at(F.lit(1), x).alias("x_first"),
        at(F.lit(2), x).alias("x_second"),
        at(n, x).alias("x_last"),
        at(n - 1, x).alias("x_next"),
    )
    u = "(1 / sqrt(n))"
    root = F.sqrt("mm")
    weighted = (
        sums.where("x_first < x_last")
        .withColumn("a_last", F.col("m_last") / root + F.expr(polynomial(LAST_WEIGHT, u)))
        .withColumn("a_next", F.col("m_next") / root + F.expr(polynomial(NEXT_WEIGHT, u)))
        .withColumn(
            "eps",
            (F.col("mm") - 2 * F.pow("m_last", F.lit(2)) - 2 * F.pow("m_next", F.lit(2)))
            / (1 - 2 * F.pow("a_last", F.lit(2)) - 2 * F.pow("a_next", F.lit(2))),
        )
    )
    top = (
        F.col("a_last") * (F.col("x_last") - F.col("x_first"))
        + F.col("a_next") * (F.col("x_next") - F.col("x_second"))
        + F.col("mx") / F.sqrt("eps")
    )
    z = f"(ln(1 - w) - {polynomial(LOG_MEAN, 'ln(n)')}) / exp({polynomial(LOG_SD, 'ln(n)')})"
    return (
        weighted.withColumn("raw", F.try_divide(top * top, F.col("ss")))
        # An infinite value leaves no statistic; least() would take NaN for the larger one.
        .withColumn("w", F.when(is_finite(F.col("raw")), F.least("raw", F.lit(1.0))))
        .withColumn(
            "p", F.when(F.col("w") >= 1, 1.0).when(F.col("w").isNotNull(), normal_upper_tail(z))
        )
        .select(*t.keys, "column", "n", "w", "p")
    )


def distributions(
    df: DataFrame | Table, by: Sequence[str] = (), listed_values: int = q.LISTED_VALUES
) -> DataFrame:
    """Quantiles, kurtosis, normality test and shape label per numeric column."""
    t = table(df, by)
    stats = ["n", "varies", "skewness", "kurtosis"]
    shape = q.moments_with_quantiles(t, t.numeric, stats, q.LEVELS, listed_values).where(
        (F.col("n") >= rules.MIN_SHAPE) & F.col("varies")
    )
    small = shapiro_wilk(t).select(*t.keys, "column", F.col("p").alias("shapiro_p"))
    shape = join_on(shape, small, [*t.by, "column"], "left")
    large = dagostino_p("n", "skewness", "kurtosis")
    p = F.when(F.col("n") < rules.SHAPIRO_LIMIT, F.col("shapiro_p")).otherwise(large)
    q05, q1, q2, q3, q95 = [F.col("q")[i] for i in range(5)]
    return (
        shape.withColumn("p", p)
        .withColumn("is_normal", is_finite(F.col("p")) & (F.col("p") > 0.05))
        .withColumn("kurtosis", finite_or(F.col("kurtosis"), 0.0))
        .select(
            *t.keys,
            "position",
            "column",
            "n",
            q1.alias("q1"),
            q2.alias("q2"),
            q3.alias("q3"),
            (q3 - q1).alias("iqr"),
            q05.alias("p5"),
            q95.alias("p95"),
            "kurtosis",
            kurtosis_label(F.col("kurtosis")).alias("kurtosis_interpretation"),
            "skewness",
            "is_normal",
            finite_or(F.col("p"), 0.0).alias("normality_p_value"),
            distribution_label(F.col("skewness"), F.col("kurtosis"), F.col("is_normal")).alias(
                "distribution_type"
            ),
        )
    )
