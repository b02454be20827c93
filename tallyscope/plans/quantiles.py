"""Exact, linearly interpolated quantiles at any size, by refinement of leading bits.

A value rounded to its leading significand bits names a cell of neighbouring values. One pass counts
the values of every cell, for all columns and groups together; sums over cells in order tell which
of them hold the wanted ranks. The next pass looks only at these, with more bits, until each holds a
single value, which is the answer. With all 53 bits a cell is a value, so five passes are the most;
as soon as the cells left hold few values, all bits are taken at once: two passes for a million rows,
three for most larger tables, one for small ones.

Counts are combined in the map tasks, no values are buffered, and no task sees a whole column: a
column has 65,536 first cells at most, a cell 8,192 parts, and copies of one value count as one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.plans.moments import moments
from tallyscope.plans.shared import written
from tallyscope.plans.table import Table, field, inlined, join_on, name_at, quoted, with_group_values

#: Significand bits of each pass.
BITS = (5, 17, 29, 41, 53)
#: So many values in all are refined by all bits at once.
LISTED_VALUES = 1 << 20
# Levels that a full analysis computes once for all its parts.
LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Larger values than this (a power of two) are their own cells, so that rounding does not overflow.
HUGE = 2.0**960


def quantiles(
    t: Table, columns: Sequence[str], probs: Sequence[float], listed_values: int = LISTED_VALUES
) -> DataFrame:
    """(keys, position, column, q) with ``q`` the exact quantiles as array<double>."""
    if t.keep and set(probs) <= set(LEVELS) and list(columns) == t.numeric:
        kept = t.kept("quantiles", lambda: _refined(t, columns, LEVELS, listed_values))
        wanted = F.array(*[F.col("q")[LEVELS.index(p)] for p in probs])
        return kept.withColumn("q", wanted)
    return _refined(t, columns, probs, listed_values)


def moments_with_quantiles(
    t: Table,
    columns: Sequence[str],
    stats: Sequence[str],
    probs: Sequence[float],
    listed_values: int = LISTED_VALUES,
) -> DataFrame:
    """Moments and quantiles, joined per column."""
    ranked = quantiles(t, columns, probs, listed_values).drop("position")
    return join_on(moments(t, columns, stats), ranked, [*t.by, "column"], "left")


def leading(value: Column, bits: int) -> Column:
    """``value`` rounded to its leading bits (Veltkamp's splitting); never decreases as it grows."""
    if bits >= BITS[-1]:
        return value
    wide = value * (2.0 ** (53 - bits) + 1)
    return F.when(F.abs(value) < HUGE, wide - (wide - value)).otherwise(value)


def _cells(values: DataFrame, group: Sequence[str], bits: int) -> DataFrame:
    """(group, n, lo, hi) for each cell of each group of ``value``s."""
    cell = leading(F.col("value"), bits).alias("__cell")
    counts = values.groupBy(*map(field, group), cell).agg(
        F.count(F.lit(1)).alias("__n"), F.min("value").alias("__lo"), F.max("value").alias("__hi")
    )
    return counts.drop("__cell")


def _holding(cells: DataFrame, group: Sequence[str], before: Column, ranks: Column) -> DataFrame:
    """The cells that hold one of the ``ranks``, with these (``__ranks``) and the values before them."""
    keys = [field(c) for c in group]
    end = before + F.sum("__n").over(Window.partitionBy(*keys).orderBy("__lo"))
    found = cells.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col("__n"))
    inside = F.filter(ranks, lambda k: (k >= F.col("__start")) & (k < F.col("__end")))
    return found.withColumn("__ranks", inside).where(F.size("__ranks") > 0)


def _wanted_ranks(total: Column, probs: Sequence[float]) -> Column:
    """The places, from 0, of the values on both sides of each quantile."""
    places = [f((total - 1) * p).cast("bigint") for p in probs for f in (F.floor, F.ceil)]
    return F.array_distinct(F.array(*places))


def _number(value: float) -> str:
    return f"double('{value!r}')"


def _narrowed(t: Table, columns: Sequence[str], open_cells: DataFrame) -> DataFrame:
    """(keys, position, part, value): the values inside the cells (keys, position, lo, hi) left."""
    group = [*t.by, "position"]
    parts = open_cells.groupBy(*map(field, group)).agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi"))).alias("c"))

    def part_of(value: str, ends: Sequence[tuple[str, str]]) -> str:
        cases = " ".join(f"WHEN {value} >= {lo} AND {value} <= {hi} THEN {i}" for i, (lo, hi) in enumerate(ends))
        return f"CASE {cases} END" if cases else "CAST(NULL AS INT)"

    def value_of(name: str) -> str:
        return f"CAST({quoted(name)} AS DOUBLE)"

    if not t.by:
        # A few numbers per column: they become constants of the generated code.
        found = {r["position"]: [(_number(lo), _number(hi)) for lo, hi in r["c"]] for r in parts.collect()}
        rows = [
            {"position": t.position[c], "part": part_of(value_of(c), found[t.position[c]]), "value": value_of(c)}
            for c in columns
            if t.position[c] in found
        ]
        return t.df.select(inlined(rows)).where("part IS NOT NULL")
    most = parts.agg(F.max(F.size("c"))).first()[0]
    ends = parts.select(*map(field, group), F.col("c.__lo").alias("__los"), F.col("c.__hi").alias("__his"))
    rows = inlined([{"position": t.position[c], "value": value_of(c)} for c in columns])
    values = t.df.select(*t.keys, rows).where("value IS NOT NULL")
    values = with_group_values(t, values, ends, group)
    part = part_of("value", [(f"get(__los, {i})", f"get(__his, {i})") for i in range(most)])
    return values.select(*t.keys, "position", F.expr(part).alias("part"), "value").where("part IS NOT NULL")


def _refined(t: Table, columns: Sequence[str], probs: Sequence[float], listed_values: int) -> DataFrame:
    if not columns:
        return t.df.select(
            *t.keys, F.lit(0).alias("position"), F.lit("").alias("column"), F.lit(None).cast("array<double>").alias("q")
        ).where(F.lit(False))
    probs = [float(p) for p in probs]
    group = [*t.by, "position"]
    passes = list(BITS)

    def bits_for(values: int) -> int:
        while len(passes) > 1 and values <= listed_values:
            passes.pop(0)
        return passes.pop(0)

    def few(cells: DataFrame) -> DataFrame:
        """Without groups the cells that hold a rank are at most ranks times columns."""
        if t.by:
            return written(cells, "cells")
        return t.spark.createDataFrame(cells.collect(), cells.schema)

    rows = inlined([{"position": t.position[c], "value": f"CAST({quoted(c)} AS DOUBLE)"} for c in columns])
    values = t.df.select(*t.keys, rows).where("value IS NOT NULL")
    whole = Window.partitionBy(*map(field, group))
    cells = _cells(values, group, bits_for(t.rows * len(columns)))
    cells = cells.withColumn("__total", F.sum("__n").over(whole))
    cells = few(_holding(cells, group, F.lit(0), _wanted_ranks(F.col("__total"), probs)))
    done = []
    while True:
        done.append(cells.where("__lo = __hi"))
        left = cells.where("__lo < __hi").drop("__end", "__n")
        size = cells.where("__lo < __hi").agg(F.sum("__n")).first()[0]
        if not size:
            break
        # A cell is known by its group and its place among the group's open cells.
        place = F.row_number().over(Window.partitionBy(*map(field, group)).orderBy("__lo")) - 1
        left = left.withColumn("part", place.cast("int"))
        inside = _cells(_narrowed(t, columns, left), [*group, "part"], bits_for(size))
        known = left.select(*map(field, group), "part", F.col("__start").alias("__before"), "__total", F.col("__ranks").alias("__asked"))
        inside = join_on(inside, known, [*group, "part"])
        cells = few(_holding(inside, [*group, "part"], F.col("__before"), F.col("__asked")).drop("part", "__before", "__asked"))
    found = reduce(DataFrame.unionByName, [d.select(*map(field, group), "__total", "__ranks", "__lo") for d in done])
    at = F.map_from_entries(F.collect_list(F.struct("rank", "__lo"))).alias("at")
    found = found.withColumn("rank", F.explode("__ranks")).groupBy(*map(field, group)).agg(F.max("__total").alias("__total"), at)

    def quantile(p: float) -> Column:
        rank = (F.col("__total") - 1) * p
        low, high = F.col("at")[F.floor(rank).cast("bigint")], F.col("at")[F.ceil(rank).cast("bigint")]
        return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))

    return found.select(*map(field, group), name_at(t, columns), F.array(*[quantile(p) for p in probs]).alias("q"))
