"""Summary of string and boolean columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import concentration_label
from tallyscope.plans.histogram import value_counts
from tallyscope.plans.table import Table, digest, join_on, name_at, quoted, table, unpivoted

TOP_VALUES = 5


def categorical_columns(t: Table) -> list[str]:
    return [c for c in t.columns if t.kinds[c] in ("string", "boolean")]


def sizes(t: Table) -> tuple[DataFrame, DataFrame | None]:
    """Cardinality and number of values per column, and the counts of single values.

    A column that is proven to have too many values for a top list needs only its
    cardinality. Its longer values then travel as 128-bit digests, so no long text is
    shuffled.
    """
    columns = categorical_columns(t)
    wide = [] if t.by else [c for c in columns if t.surely_more_than(c, rules.HIGH_CARDINALITY)]
    counted = [c for c in columns if c not in wide]
    group = [*t.keys, F.col("position"), F.col("column")]
    size = [F.count(F.lit(1)).alias("cardinality"), F.sum("n").alias("total")]
    counts = value_counts(t, counted) if counted else None
    parts = [counts.groupBy(*group).agg(*size)] if counted else []
    if wide:
        short = (
            t.df.select(unpivoted(t, wide, quoted))
            .where("value is not null")
            .withColumn("value", digest(F.col("value")))
            .groupBy("position", "value")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("position", name_at(t, wide), "value", "n")
        )
        parts.append(short.groupBy(*group).agg(*size))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if t.by:
        rows = t.df.groupBy(*t.keys).agg(F.count(F.lit(1)).alias("rows"))
        found = join_on(found, rows, t.by)
    else:
        found = found.withColumn("rows", F.lit(t.rows))
    high = (F.col("cardinality") > rules.HIGH_CARDINALITY) | (
        F.col("cardinality") > rules.HIGH_CARDINALITY_RATIO * F.col("rows")
    )
    return found.withColumn("is_high_cardinality", high).drop("rows"), counts


def top_of(t: Table, counts: DataFrame, k: int) -> DataFrame:
    """Most frequent values with their rank; ties go to the smaller value.

    Spark cuts each task's share to ``k`` rows per column before it shuffles.
    """
    order = Window.partitionBy(*t.keys, "position", "column").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def category_top_values(
    df: DataFrame | Table, k: int = TOP_VALUES, by: Sequence[str] = ()
) -> DataFrame:
    """(keys, position, column, rank, value, count, pct) for columns of low cardinality."""
    t = table(df, by)
    schema = "position int, column string, rank int, value string, count bigint, pct double"
    found, counts = sizes(t) if categorical_columns(t) else (None, None)
    if counts is None:
        return t.spark.createDataFrame([], schema)
    low = found.where(~F.col("is_high_cardinality")).select(*t.keys, "column", "total")
    return join_on(top_of(t, counts, k), low, [*t.by, "column"]).select(
        *t.keys,
        "position",
        "column",
        "rank",
        "value",
        F.col("n").alias("count"),
        (F.col("n") * 100.0 / F.col("total")).alias("pct"),
    )


def categorical_summary(df: DataFrame | Table, by: Sequence[str] = ()) -> DataFrame:
    """Cardinality, share outside the top five, and concentration per column."""
    t = table(df, by)
    if not categorical_columns(t):
        return t.spark.createDataFrame(
            [],
            "position int, column string, cardinality bigint, is_high_cardinality boolean, "
            "other_pct double, concentration string, top_value string, top_pct double",
        )
    found, counts = sizes(t)
    if counts is None:
        found = found.withColumns(
            {"top_n": F.lit(0), "first_n": F.lit(0), "top_value": F.lit(None).cast("string")}
        )
    else:
        top = (
            top_of(t, counts, TOP_VALUES)
            .groupBy(*t.keys, "column")
            .agg(
                F.sum("n").alias("top_n"),
                F.max("n").alias("first_n"),
                F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("top_value"),
            )
        )
        found = join_on(found, top, [*t.by, "column"], "left")
    high = F.col("is_high_cardinality")
    first = F.col("first_n") / F.col("total")
    return found.select(
        *t.keys,
        "position",
        "column",
        "cardinality",
        "is_high_cardinality",
        F.when(high, 100.0)
        .otherwise((F.col("total") - F.col("top_n")) * 100.0 / F.col("total"))
        .alias("other_pct"),
        F.when(high, "dispersed").otherwise(concentration_label(first)).alias("concentration"),
        F.when(~high, F.col("top_value")).alias("top_value"),
        F.when(~high, first * 100).alias("top_pct"),
    )
