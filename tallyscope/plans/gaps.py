"""Differences of neighbouring values in order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.plans.shared import written
from tallyscope.plans.table import field


def gaps(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, gap, n): how often each group has a difference between neighbours in the order of ``value``.

    Distinct values with their counts are cut into ranges. Inside a range each value is compared with
    the one before it; the first of a range with the last of the group's range before, which is all
    that is carried from one range to the next. Repeated values are gaps of zero.
    """
    group = [field(k) for k in keys]
    counts = written(rows.groupBy(*group, field(value)).agg(F.count(F.lit(1)).alias("__n")), "gap-values")
    placed = counts.repartitionByRange(*group, field(value)).withColumn("__range", F.spark_partition_id())
    placed = written(placed, "gap-ranges")
    inside = Window.partitionBy(*group, "__range").orderBy(value)
    within = placed.select(*group, (field(value) - F.lag(value).over(inside)).alias("gap"), F.lit(1).cast("bigint").alias("n"))
    # One row per group and range from here on.
    ends = placed.groupBy(*group, "__range").agg(F.min(value).alias("__first"), F.max(value).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*group).orderBy("__range"))
    between = ends.select(*group, (F.col("__first") - before).alias("gap"), F.lit(1).cast("bigint").alias("n"))
    repeats = counts.groupBy(*group).agg(F.sum(F.col("__n") - 1).alias("n"))
    zeros = repeats.select(*group, F.lit(0).cast(rows.schema[value].dataType).alias("gap"), "n")
    return within.unionByName(between).unionByName(zeros).where("gap IS NOT NULL AND n > 0")
