"""Summary of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import finite_or, skew_label
from tallyscope.plans import quantiles as q
from tallyscope.plans.table import Table, table


def numeric_summary(
    df: DataFrame | Table, by: Sequence[str] = (), listed_values: int = q.LISTED_VALUES
) -> DataFrame:
    """Mean, median, standard deviation, range and skewness per numeric column.

    Columns with fewer than ten values or a single value are left out.
    """
    t = table(df, by)
    stats = ["n", "mean", "std", "min", "max", "varies", "skewness"]
    return (
        q.moments_with_quantiles(t, t.numeric, stats, [0.5], listed_values)
        .where((F.col("n") >= rules.MIN_SUMMARY) & F.col("varies"))
        .withColumn("skewness", finite_or(F.col("skewness"), 0.0))
        .select(
            *t.keys,
            "position",
            "column",
            "n",
            finite_or(F.col("mean"), 0.0).alias("mean"),
            F.col("q")[0].alias("median"),
            finite_or(F.col("std"), 0.0).alias("std"),
            "min",
            "max",
            "skewness",
            skew_label(F.col("skewness")).alias("skew_interpretation"),
        )
    )
