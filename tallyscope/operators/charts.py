"""Small aggregated tables ready to be drawn."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import finite_or
from tallyscope.operators.schema import temporal_strings
from tallyscope.operators.temporal import period_end, period_start
from tallyscope.plans.moments import moments
from tallyscope.plans.table import Table, exact_distinct, field, table

BARS = 15
SLICES = 10
BINS = 30
POINTS = 1000
POINT_SEED = 42
NEARLY_UNIQUE = 0.8


def aggregated(column: str, how: str) -> Column:
    value = field(column)
    if how == "mean":
        return F.avg(value)
    if how == "count":
        return F.count(value)
    return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))


def x_axis(t: Table, x: str) -> Column:
    """Dates as timestamps, anything else as it is; text counts as dates if most of it is."""
    if t.kinds[x] == "temporal" or temporal_strings(t, [x] if t.kinds[x] == "string" else []):
        return t.moment(x)
    return field(x)


def chart_line(
    df: DataFrame | Table, x: str, y: str, aggregation: str = "sum", grain: str | None = None
) -> DataFrame:
    """(x, y) sorted by x: sum, mean or count of y per x, or the raw pairs for "none".

    With ``grain`` x becomes a calendar period, for axes with very many instants.
    """
    t = table(df)
    axis = x_axis(t, x)
    if grain is not None:
        axis = period_end(period_start(F.to_date(axis), F.lit(grain)), F.lit(grain))
    rows = t.df.withColumn("__x", axis).where("__x is not null")
    if aggregation == "none":
        pairs = rows.select(F.col("__x").alias("x"), field(y).alias("y")).where("y is not null")
        return pairs.orderBy("x")
    grouped = rows.groupBy(F.col("__x").alias("x")).agg(aggregated(y, aggregation).alias("y"))
    return grouped.orderBy("x")


def chart_area(
    df: DataFrame | Table, x: str, y: str, aggregation: str = "sum", grain: str | None = None
) -> DataFrame:
    """As a line, for sums and means; other aggregations give the raw pairs."""
    return chart_line(df, x, y, aggregation if aggregation in ("sum", "mean") else "none", grain)


def top_groups(t: Table, x: str, y: str | None, aggregation: str, n: int) -> DataFrame:
    value = F.count(F.lit(1)) if y is None or aggregation == "none" else aggregated(y, aggregation)
    return (
        t.df.where(field(x).isNotNull())
        .groupBy(field(x).alias("x"))
        .agg(value.alias("y"))
        .orderBy(F.desc_nulls_last("y"), "x")
        .limit(n)
    )


def chart_bar(
    df: DataFrame | Table, x: str, y: str | None = None, aggregation: str = "sum", bars: int = BARS
) -> DataFrame:
    """(x, y): the ``bars`` largest groups, or most frequent values without ``y``."""
    return top_groups(table(df), x, y, aggregation, bars)


def chart_donut(
    df: DataFrame | Table, x: str, y: str | None = None, aggregation: str = "sum", slices: int = SLICES
) -> DataFrame:
    """(x, y): the ``slices`` largest slices; anything but a mean is a sum."""
    return top_groups(table(df), x, y, "mean" if aggregation == "mean" else "sum", slices)


def chart_histogram(df: DataFrame | Table, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lower, upper, count) over equal-width bins, empty bins left out.

    The bins span the finite values. Infinities come in bins of their own, -1 and ``bins``.
    """
    t = table(df)
    value = field(column).cast("double")
    finite = finite_or(value, None)
    ends = t.df.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi")).first()
    if ends["lo"] is None:
        lo, width = 0.0, 0.0
    else:
        lo, width = ends["lo"], ends["hi"] / bins - ends["lo"] / bins
    number = F.lit(0)
    if width > 0:
        number = F.least(F.floor((finite - lo) / width).cast("int"), F.lit(bins - 1))
    number = F.when(finite.isNotNull(), number).when(value > 0, bins).otherwise(-1)
    inside = F.col("bin").between(0, bins - 1)
    lower, upper = F.lit(lo) + F.col("bin") * F.lit(width), F.lit(lo) + (F.col("bin") + 1) * F.lit(width)
    return (
        t.df.where(value.isNotNull())
        .groupBy(number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            "bin",
            F.when(inside | (F.col("bin") > 0), lower).otherwise(float("-inf")).alias("lower"),
            F.when(inside | (F.col("bin") < 0), upper).otherwise(float("inf")).alias("upper"),
            "count",
        )
    )


def chart_scatter(
    df: DataFrame | Table, x: str, y: str, points: int = POINTS, seed: int = POINT_SEED
) -> DataFrame:
    """(x, y): all complete pairs, or a sample of exactly ``points`` that repeats itself.

    The sample is the rows with the smallest hashes, so each task sends on at most
    ``points`` rows and the result does not depend on how the table is split.
    """
    t = table(df)
    order = F.xxhash64(*[field(c) for c in t.df.columns], F.lit(seed))
    return (
        t.df.where(field(x).isNotNull() & field(y).isNotNull())
        .select(field(x).alias("x"), field(y).alias("y"), order.alias("order"))
        .orderBy("order", "x", "y")
        .limit(points)
        .select("x", "y")
    )


def metric_comparison(
    df: DataFrame | Table, columns: Sequence[str] | None = None, aggregation: str = "mean"
) -> DataFrame:
    """(metric, value), largest first, without columns that look like keys.

    That is by name, or by more than 0.8 distinct values per row. Only columns whose
    number of values and, for integers, range leave that open are counted.
    """
    t = table(df)
    named = [
        c
        for c in (t.numeric if columns is None else columns)
        if c in t.numeric and not any(w in c.lower() for w in rules.KEY_WORDS)
    ]
    if not named:
        return t.spark.createDataFrame([], "metric string, value double")
    stat = {"sum": "sum", "count": "n"}.get(aggregation, "mean")
    stats = list(dict.fromkeys(["n", "min", "max", stat]))
    facts = {r["column"]: r for r in moments(t, named, stats).collect()}
    limit = NEARLY_UNIQUE * t.rows

    def may_be_key(c: str) -> bool:
        possible = facts[c]["n"]
        if t.kinds[c] == "integer" and possible:
            possible = min(possible, facts[c]["max"] - facts[c]["min"] + 1)
        return possible > limit

    counted = exact_distinct(t, [c for c in named if may_be_key(c)])
    kept = [c for c in named if counted.get(c, 0) <= limit]
    return t.spark.createDataFrame(
        [(c, float(facts[c][stat] or 0)) for c in kept], "metric string, value double"
    ).orderBy(F.desc("value"), "metric")
