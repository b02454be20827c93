"""Outliers beyond the quartile fences, and suspicious zeros and negatives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.plans import quantiles as q
from tallyscope.plans.moments import moments
from tallyscope.plans.shared import written
from tallyscope.plans.table import (
    Table,
    field,
    inlined,
    join_on,
    quoted,
    table,
    text,
    unpivoted,
    with_group_values,
)

FENCE = 1.5
EXAMPLES_PER_SIDE = 2
NEGATIVE_EXAMPLES = 3


def fences(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    quartiles: DataFrame | None = None,
    listed_values: int = q.LISTED_VALUES,
) -> DataFrame:
    """(keys, position, column, n, lower_bound, upper_bound) of testable columns.

    ``quartiles`` may be an existing ``distributions`` result.
    """
    t = table(df, by)
    if quartiles is None:
        found = q.moments_with_quantiles(t, t.numeric, ["n", "varies"], [0.25, 0.75], listed_values)
        quartiles = found.where(
            (F.col("n") >= rules.MIN_SHAPE) & F.col("varies")
        ).withColumns({"q1": F.col("q")[0], "q3": F.col("q")[1]})
    iqr = F.col("q3") - F.col("q1")
    return quartiles.select(
        *t.keys,
        "position",
        "column",
        "n",
        (F.col("q1") - FENCE * iqr).alias("lower_bound"),
        (F.col("q3") + FENCE * iqr).alias("upper_bound"),
    )


def with_fences(t: Table, rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Attach ``lower``/``upper`` arrays, indexed like ``t.numeric``; null where untested."""
    ends = bounds.groupBy(*t.keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("column", F.struct("lower_bound", "upper_bound")))
        ).alias("ends")
    )
    arrays = [
        F.array(*[F.col("ends")[F.lit(c)][side] for c in t.numeric]).alias(name)
        for side, name in (("lower_bound", "lower"), ("upper_bound", "upper"))
    ]
    if not t.by:
        # An empty aggregate still yields its one row, with an empty map.
        return with_group_values(t, rows, ends.select(*arrays))
    return with_group_values(t, rows, ends.select(*t.keys, *arrays))


def column_outliers(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    bounds: DataFrame | None = None,
    listed_values: int = q.LISTED_VALUES,
) -> DataFrame:
    """Number, share and direction of values strictly beyond the fences."""
    t = table(df, by)
    if not t.numeric:
        return _empty(t, "position int, column string, n bigint, outlier_count bigint, "
                         "outlier_pct double, lower_bound double, upper_bound double, "
                         "low_count bigint, high_count bigint, direction string")  # fmt: skip
    bounds = fences(t, listed_values=listed_values) if bounds is None else bounds
    rows = with_fences(t, t.df, bounds)
    facts = ("n", "low_count", "high_count", "lower_bound", "upper_bound")
    wanted = [
        F.expr(
            f"struct(count({c}) AS n, count_if({c} < lower[{i}]) AS low_count, "
            f"count_if({c} > upper[{i}]) AS high_count, max(lower[{i}]) AS lower_bound, "
            f"max(upper[{i}]) AS upper_bound) AS __{i}"
        )
        for i, c in enumerate(map(quoted, t.numeric))
    ]
    counted = rows.groupBy(*t.keys).agg(*wanted)
    long = inlined(
        [
            {"position": t.position[c], "column": text(c)} | {f: f"__{i}.{f}" for f in facts}
            for i, c in enumerate(t.numeric)
        ]
    )
    low, high = F.col("low_count"), F.col("high_count")
    return (
        counted.select(*t.keys, long)
        .where(low + high > 0)
        .select(
            *t.keys,
            "position",
            "column",
            "n",
            (low + high).alias("outlier_count"),
            ((low + high) * 100.0 / F.col("n")).alias("outlier_pct"),
            "lower_bound",
            "upper_bound",
            "low_count",
            "high_count",
            F.when((low > 0) & (high > 0), "both").when(high > 0, "high").otherwise("low").alias(
                "direction"
            ),
        )
    )


def _empty(t: Table, schema: str) -> DataFrame:
    columns = [c.split() for c in schema.split(", ")]
    return t.df.select(
        *t.keys, *[F.lit(None).cast(kind).alias(name) for name, kind in columns]
    ).where(F.lit(False))


def identified(t: Table, row_id: str | None) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """Rows with columns that order and identify them, and what turns these into ``row_index``.

    A given column is the identifier. Rows of Parquet files are known by file and place in it, which
    no second scan is needed for and no way of cutting files into tasks changes; only the numbers
    of rows of the files, from their footers, are added to the few rows that are looked up. For other
    sources rows are counted per partition first, so the table must come in the same
    partitions when it is read twice.
    """
    if row_id is not None:
        return t.df.withColumn("__id", field(row_id)), ["__id"], lambda rows: rows.withColumnRenamed("__id", "row_index")
    try:
        placed = t.df.withColumns({"__file": F.col("_metadata.file_path"), "__place": F.col("_metadata.row_index")})
    except AnalysisException:
        numbered, place = _numbered(t)
        return numbered.withColumn("__id", place), ["__id"], lambda rows: rows.withColumnRenamed("__id", "row_index")

    def indexed(rows: DataFrame) -> DataFrame:
        files = [r["__file"] for r in rows.select("__file").distinct().take(2)]
        if len(files) < 2 and len(t.source.select("_metadata.file_path").distinct().take(2)) < 2:
            return rows.withColumnRenamed("__place", "row_index").drop("__file")
        sizes = t.source.groupBy(F.col("_metadata.file_path").alias("__file")).agg(F.count(F.lit(1)).alias("__rows"))
        before = F.sum("__rows").over(Window.orderBy("__file")) - F.col("__rows")
        return (
            rows.join(sizes.select("__file", before.alias("__before")), "__file")
            .withColumn("row_index", F.col("__before") + F.col("__place"))
            .drop("__file", "__place", "__before")
        )

    return placed, ["__file", "__place"], indexed


def _numbered(t: Table) -> tuple[DataFrame, Column]:
    place = F.monotonically_increasing_id()
    part = F.shiftright(F.col("__place"), 33)
    numbered = t.df.withColumn("__place", place)
    counts = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, total = [], 0
    for r in sorted(counts):
        starts.append((r["part"], total))
        total += r["n"]
    offsets = t.spark.createDataFrame(starts, "__part bigint, __start bigint")
    rows = numbered.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return rows, F.col("__start") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))


def outlier_examples(
    df: DataFrame | Table,
    by: Sequence[str] = (),
    row_id: str | None = None,
    bounds: DataFrame | None = None,
    listed_values: int = q.LISTED_VALUES,
) -> DataFrame:
    """(keys, position, column, side, rank, row_index, value): the most extreme outliers.

    Two per side. Spark keeps only two rows per column and side of each task before the
    shuffle, so the number of outliers does not matter.
    """
    t = table(df, by)
    if not t.numeric:
        return _empty(t, "position int, column string, side string, rank int, "
                         "row_index bigint, value double")  # fmt: skip
    bounds = fences(t, listed_values=listed_values) if bounds is None else bounds
    base, ids, indexed = identified(t, row_id)
    rows = with_fences(t, base, bounds)
    index = {c: i for i, c in enumerate(t.numeric)}

    def beyond(c: str) -> str:
        value, i = f"CAST({quoted(c)} AS DOUBLE)", index[c]
        return (
            f"CASE WHEN {value} < lower[{i}] THEN struct({value} AS value, 'low' AS side)"
            f" WHEN {value} > upper[{i}] THEN struct({value} AS value, 'high' AS side) END"
        )

    found = (
        rows.select(*t.keys, *ids, unpivoted(t, t.numeric, beyond))
        .where("value is not null")
        .select(*t.keys, "position", "column", *ids, "value.value", "value.side")
    )
    extreme = F.when(F.col("side") == "low", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy(*t.keys, "position", "column", "side").orderBy(extreme, *ids)
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EXAMPLES_PER_SIDE)
    # Two rows per group, column and side from here on.
    return indexed(written(first, "examples")).select(*t.keys, "position", "column", "side", "rank", "row_index", "value")


def suspicious_values(
    df: DataFrame | Table, by: Sequence[str] = (), row_id: str | None = None
) -> DataFrame:
    """(keys, position, column, issue, count, examples) for oddly zero or negative figures."""
    t = table(df, by)
    revenue = [c for c in t.numeric if rules.named_like(c, rules.REVENUE_NAME)]
    named = [c for c in t.numeric if c in revenue or rules.named_like(c, rules.COUNT_NAME)]
    positive = [c for c in revenue if not any(w in c.lower() for w in rules.CHANGE_WORDS)]
    schema = "position int, column string, issue string, count bigint, examples array<double>"
    if not named:
        return _empty(t, schema)
    facts = moments(t, named, ["n", "varies", "zeros", "negatives"]).where(
        (F.col("n") >= rules.MIN_SHAPE) & F.col("varies")
    )
    few_zeros = (F.col("zeros") > 0) & (F.col("zeros") < 0.5 * F.col("n"))
    zeros = facts.where(few_zeros).select(
        *t.keys, "position", "column", F.lit("unexpected_zeros").alias("issue"),
        F.col("zeros").alias("count"), F.array(F.lit(0.0)).alias("examples"),
    )
    negative = facts.where(F.col("column").isin(positive) & (F.col("negatives") > 0)).select(
        *t.keys, "position", "column", F.col("negatives").alias("count")
    )
    if not t.by:  # a few rows: columns without negative values are not looked through
        some = {r["column"] for r in negative.collect()}
        positive = [c for c in positive if c in some]
    if not positive:
        return zeros
    base, ids, _ = identified(t, row_id)
    values = base.select(
        *t.keys,
        *ids,
        unpivoted(t, positive, lambda c: f"IF({quoted(c)} < 0, CAST({quoted(c)} AS DOUBLE), NULL)"),
    )
    order = Window.partitionBy(*t.keys, "position").orderBy(*ids)
    first = (
        values.where("value is not null")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= NEGATIVE_EXAMPLES)
        .groupBy(*t.keys, "position")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value")))["value"].alias("examples"))
    )
    negatives = join_on(negative, first, [*t.by, "position"]).select(
        *t.keys, "position", "column", F.lit("unexpected_negatives").alias("issue"),
        "count", "examples",
    )
    return zeros.unionByName(negatives)


def outlier_summary(
    df: DataFrame | Table, by: Sequence[str] = (), outliers: DataFrame | None = None
) -> DataFrame:
    """(keys, total_outliers, outlier_pct) over rows times all numeric columns."""
    t = table(df, by)
    outliers = column_outliers(t) if outliers is None else outliers
    total = F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("total_outliers")
    sums = outliers.groupBy(*t.keys).agg(total)
    cells = F.col("rows") * max(len(t.numeric), 1)
    if t.by:
        rows = t.df.groupBy(*t.keys).agg(F.count(F.lit(1)).alias("rows"))
        sums = join_on(sums, rows, t.by)
    else:
        sums = sums.withColumn("rows", F.lit(t.rows))
    return sums.select(
        *t.keys,
        "total_outliers",
        F.coalesce(F.try_divide(F.col("total_outliers") * 100.0, cells), F.lit(0.0)).alias(
            "outlier_pct"
        ),
    )


def z_score_outliers(df: DataFrame | Table, by: Sequence[str] = (), limit: float = 3.0) -> DataFrame:
    """(keys, position, column, n, z_count): values further than ``limit`` deviations out."""
    t = table(df, by)
    stats = moments(t, t.numeric, ["n", "mean", "std"])
    ends = stats.where((F.col("n") >= rules.MIN_SHAPE) & (F.col("std") > 0)).select(
        *t.keys,
        "position",
        "column",
        "n",
        (F.col("mean") - limit * F.col("std")).alias("lower_bound"),
        (F.col("mean") + limit * F.col("std")).alias("upper_bound"),
    )
    return column_outliers(t, bounds=written(ends, "ends")).select(
        *t.keys, "position", "column", "n", F.col("outlier_count").alias("z_count")
    )
