"""Pairwise Pearson correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import correlation_strength, is_finite
from tallyscope.functions.probability import t_two_sided
from tallyscope.plans.comoments import comoments
from tallyscope.plans.table import Table, name_at, table

TOP_PAIRS = 5
COLLINEAR = 0.9


def correlations(
    df: DataFrame | Table,
    max_columns: int | None = rules.CORRELATED_COLUMNS,
    by: Sequence[str] = (),
) -> DataFrame:
    """(keys, column_a, column_b, n, r, p_value, strength, flags) for a before b.

    Constant columns and tables or groups under 30 rows give no pairs. All pairs of any number of
    columns come from one scan (see ``plans/comoments.py``), over the rows that have both values.
    """
    t = table(df, by)
    columns = t.numeric[:max_columns]
    if len(columns) < 2:
        return t.df.select(
            *t.keys,
            *[F.lit(0).alias(c) for c in ("position_a", "position_b")],
            *[F.lit("").alias(c) for c in ("column_a", "column_b")],
            F.lit(0).cast("bigint").alias("n"),
            *[F.lit(0.0).alias(c) for c in ("r", "p_value")],
            F.lit("").alias("strength"),
            *[F.lit(False).alias(c) for c in ("is_significant", "is_collinear")],
        ).where(F.lit(False))
    raw = F.try_divide("c", F.sqrt("m2_a") * F.sqrt("m2_b"))
    r = F.col("r")
    df_ = F.greatest(F.col("n") - 2, F.lit(1)).cast("double")
    inside = F.when(F.abs(r) < 1, 1 - r * r)
    t_value = F.when(F.abs(r) < 1, r * F.sqrt(df_ / inside)).otherwise(r * float("inf"))
    p = F.when(F.col("n") < 3, 1.0).otherwise(t_two_sided("t_value", "df"))
    return (
        comoments(t, columns)
        .where(F.col("rows") >= rules.MIN_SHAPE)
        .withColumn("raw", raw)
        .withColumn("r", F.when(F.abs("raw") > 1, F.signum("raw")).otherwise(F.col("raw")))
        .where(is_finite(r))
        .withColumn("df", df_)
        .withColumn("t_value", t_value)
        .withColumn("p_value", p)
        .select(
            *t.keys,
            "position_a",
            "position_b",
            name_at(t, columns, "position_a").alias("column_a"),
            name_at(t, columns, "position_b").alias("column_b"),
            "n",
            "r",
            "p_value",
            correlation_strength(r).alias("strength"),
            ((F.abs(r) >= 0.3) & (F.col("p_value") < 0.05)).alias("is_significant"),
            (F.abs(r) > COLLINEAR).alias("is_collinear"),
        )
    )


def collinearity(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    max_columns: int | None = rules.CORRELATED_COLUMNS,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """(keys, collinear_pairs, has_multicollinearity); ``pairs`` may be a ``correlations`` result.

    A group without any pair has no row; without keys there is always one.
    """
    t = table(df, by)
    pairs = correlations(t, max_columns) if pairs is None else pairs
    counted = pairs.groupBy(*t.keys).agg(F.count_if("is_collinear").alias("collinear_pairs"))
    return counted.withColumn("has_multicollinearity", F.col("collinear_pairs") > 0)


def significant_pairs(
    df: DataFrame | Table, by: Sequence[str] = (), max_columns: int | None = rules.CORRELATED_COLUMNS
) -> DataFrame:
    """Significant pairs, strongest first, with a sentence about each."""
    pairs = correlations(df, max_columns, by)
    return (
        pairs.where("is_significant")
        .withColumn(
            "interpretation",
            F.format_string(
                "%s and %s show %s correlation",
                "column_a",
                "column_b",
                F.replace(F.col("strength"), F.lit("_"), F.lit(" ")),
            ),
        )
        .orderBy(F.desc(F.abs("r")), "position_a", "position_b")
    )


def top_correlations(df: DataFrame | Table, k: int = TOP_PAIRS, **options) -> DataFrame:
    return significant_pairs(df, **options).limit(k)
