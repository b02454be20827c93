"""Performance of key figures across the values of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.plans.histogram import kept_counts, shared
from tallyscope.plans.table import Table, field, inlined, quoted, table, text

TOP_SEGMENTS = 10


def segment_columns(t: Table) -> list[str]:
    low, high = rules.SEGMENT_CARDINALITY
    counts = t.low_cardinality(t.strings, high)
    return [c for c in t.strings if counts[c] is not None and counts[c] >= low]


def segment_kpis(t: Table) -> list[str]:
    named = [
        c
        for c in t.numeric
        if rules.named_like(c, rules.REVENUE_NAME) or rules.named_like(c, rules.COUNT_NAME)
    ]
    return named or t.numeric[:1]


def all_segments(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    segment_cols: Sequence[str] | None = None,
    kpi_cols: Sequence[str] | None = None,
) -> DataFrame:
    """Every segment of every (segment column, key figure) pair, ranked by its sum.

    All segment columns are grouped in one pass: a row is repeated once per segment
    column and folded by the map-side aggregation at once. After it there are at most 20
    values per segment column and group, which is all the windows see.
    """
    t = table(df, by)
    columns = list(segment_cols or segment_columns(t)[: rules.SEGMENT_COLUMNS])
    figures = list(kpi_cols or segment_kpis(t)[: rules.SEGMENT_KPIS])
    if not columns or not figures:
        return t.df.select(
            *t.keys,
            F.lit(0).alias("segment_position"),
            F.lit("").alias("segment_column"),
            F.lit(0).alias("kpi_position"),
            F.lit("").alias("kpi_column"),
            F.lit("").alias("value"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("count",)],
            *[
                F.lit(0.0).alias(c)
                for c in ("count_pct", "kpi_value", "kpi_mean", "kpi_contribution_pct")
            ],
            F.lit(0).alias("rank"),
            F.lit(0).cast("bigint").alias("segments"),
        ).where(F.lit(False))
    pair = inlined(
        [
            {"segment_position": t.position[c], "segment_column": text(c), "value": quoted(c)}
            for c in columns
        ]
    )
    sums = []
    for i, c in enumerate(figures):
        sums += [F.sum(f"k{i}").alias(f"s{i}"), F.count(f"k{i}").alias(f"n{i}")]
    if shared(t, columns) and figures == t.summed:
        grouped = kept_counts(t, columns).withColumnsRenamed({"position": "segment_position", "column": "segment_column"})
    else:
        grouped = (
            t.df.select(
                *t.keys,
                *[field(c).cast("double").alias(f"k{i}") for i, c in enumerate(figures)],
                pair,
            )
            .where("value is not null")
            .groupBy(*t.keys, "segment_position", "segment_column", "value")
            .agg(*sums)
        )
    per_kpi = inlined(
        [
            {
                "kpi_position": t.position[c],
                "kpi_column": text(c),
                "kpi_value": f"coalesce(s{i}, 0D)",
                "kpi_mean": f"try_divide(s{i}, n{i})",
                "count": f"n{i}",
            }
            for i, c in enumerate(figures)
        ]
    )
    keys = [*t.by, "segment_position", "segment_column", "kpi_position", "kpi_column"]
    whole = Window.partitionBy(*[field(c) for c in keys])
    ranked = whole.orderBy(F.desc("kpi_value"), "value")
    return (
        grouped.select(*t.keys, "segment_position", "segment_column", "value", per_kpi)
        .withColumn("total", F.sum("kpi_value").over(whole))
        .withColumn("total_count", F.sum("count").over(whole))
        .withColumn("segments", F.count(F.lit(1)).over(whole))
        .withColumn("rank", F.row_number().over(ranked))
        .where("segments >= 2 and total <> 0 and total_count <> 0")
        .select(
            *[field(c) for c in keys],
            "value",
            "count",
            (F.col("count") * 100.0 / F.col("total_count")).alias("count_pct"),
            "kpi_value",
            "kpi_mean",
            (F.col("kpi_value") * 100.0 / F.col("total")).alias("kpi_contribution_pct"),
            "rank",
            "segments",
        )
    )


def segments(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    ranked: DataFrame | None = None,
    top: int | None = TOP_SEGMENTS,
    **columns,
) -> DataFrame:
    """The ``top`` best segments per pair; ``ranked`` may be an ``all_segments`` result."""
    ranked = all_segments(df, by, **columns) if ranked is None else ranked
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.drop("segments")


def segment_insights(
    df: DataFrame | Table, by: Sequence[str] = (), ranked: DataFrame | None = None, **columns
) -> DataFrame:
    """Best and worst segment, their ratio, and the concentration (sum of squared shares)."""
    t = table(df, by)
    ranked = all_segments(t, **columns) if ranked is None else ranked
    keys = [*t.by, "segment_position", "segment_column", "kpi_position", "kpi_column"]
    share = F.col("kpi_contribution_pct") / 100
    top, bottom = F.col("rank"), F.col("segments")
    return (
        ranked.groupBy(*[field(c) for c in keys])
        .agg(
            F.max(F.when(top == 1, F.col("value"))).alias("top_value"),
            F.max(F.when(top == 1, F.col("kpi_value"))).alias("top_kpi"),
            F.max(F.when(top == bottom, F.col("value"))).alias("bottom_value"),
            F.max(F.when(top == bottom, F.col("kpi_value"))).alias("bottom_kpi"),
            F.sum(share * share).alias("concentration_index"),
        )
        .select(
            "*", F.try_divide("top_kpi", "bottom_kpi").alias("performance_spread")
        )
    )
