"""Moments pass: one aggregation for all numeric columns, one result row per column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.plans.table import FIELD_BUDGET, Fact, Table, inlined, quoted, text

# How each statistic is computed, as SQL over a column.
SQL = {
    "n": "count({c})",
    "min": "CAST(min({c}) AS DOUBLE)",
    "max": "CAST(max({c}) AS DOUBLE)",
    "varies": "min({c}) <> max({c})",
    "sum": "sum(CAST({c} AS DOUBLE))",
    "mean": "try_divide(sum(CAST({c} AS DOUBLE)), count({c}))",
    "std": "stddev_samp({c})",
    "skewness": "skewness({c})",
    "kurtosis": "kurtosis({c})",
    "zeros": "count_if({c} = 0)",
    "negatives": "count_if({c} < 0)",
}
# Aggregation buffer fields of each.
WIDTH = {
    "n": 1, "min": 1, "max": 1, "varies": 0, "sum": 1, "mean": 0, "std": 3, "skewness": 4, "kurtosis": 5,
    "zeros": 1, "negatives": 1,
}


def fact(stat: str, t: Table, column: str) -> tuple[str, Fact]:
    """The name of a column's statistic among a table's facts, and how it is computed."""
    return f"{stat}_{t.position[column]}", Fact(F.expr(SQL[stat].format(c=quoted(column))), WIDTH[stat])


def declared(t: Table) -> dict[str, Fact]:
    return dict(fact(stat, t, c) for c in t.numeric for stat in SQL)


def batches(columns: Sequence[str], width: int) -> list[list[str]]:
    size = max(1, FIELD_BUDGET // width)
    return [list(columns[i : i + size]) for i in range(0, len(columns), size)]


def moments(
    t: Table,
    columns: Sequence[str],
    stats: Sequence[str],
) -> DataFrame:
    """(keys, position, column, *stats) for the given numeric columns."""
    if not columns:
        return empty_like(t, stats)
    if t.keep:
        wide = t.facts(dict(fact(s, t, c) for c in columns for s in stats))
        rows = [
            {"position": t.position[c], "column": text(c)} | {s: fact(s, t, c)[0] for s in stats} for c in columns
        ]
        return wide.select(*t.keys, inlined(rows))
    parts = []
    for names in batches(columns, max(1, sum(WIDTH[s] for s in stats))):
        wide, rows = [], []
        for i, name in enumerate(names):
            c = quoted(name)
            values = [f"{SQL[s].format(c=c)} AS {s}" for s in stats]
            wide.append(F.expr(f"struct({', '.join(values)}) AS __{i}"))
            rows.append(
                {"position": t.position[name], "column": text(name)}
                | {s: f"__{i}.{s}" for s in stats}
            )
        parts.append(t.df.groupBy(*t.keys).agg(*wide).select(*t.keys, inlined(rows)))
    return reduce(DataFrame.unionByName, parts)


def empty_like(t: Table, stats: Sequence[str]) -> DataFrame:
    kinds = dict.fromkeys(("n", "zeros", "negatives"), "bigint") | {"varies": "boolean"}
    columns = [F.lit(0).alias("position"), F.lit("").alias("column")]
    columns += [F.lit(None).cast(kinds.get(s, "double")).alias(s) for s in stats]
    return t.df.select(*t.keys, *columns).where(F.lit(False))
