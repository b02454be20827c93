"""Value histogram: how often each value of each string or boolean column occurs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.plans.table import Table, name_at, quoted, unpivoted


def value_counts(t: Table, columns: Sequence[str]) -> DataFrame:
    """(keys, position, column, value, n), nulls left out.

    Counts are combined in the map tasks, so a value that fills a third of the table
    arrives at the shuffle as one row per task. A full analysis counts once for all its parts.
    """
    if shared(t, columns):
        return kept_counts(t, columns).select(*t.keys, "position", "column", "value", "n")
    return _counted(t, columns)


def shared(t: Table, columns: Sequence[str]) -> bool:
    """Whether a full analysis counts these columns for all its parts."""
    return t.keep and set(columns) <= set(t.counted_columns())


def kept_counts(t: Table, columns: Sequence[str]) -> DataFrame:
    """``value_counts`` with the sum and number (s0, n0, ...) of each column of ``t.summed``."""
    kept = t.kept("value counts", lambda: _counted(t, t.counted_columns(), t.summed))
    return kept.where(F.col("position").isin([t.position[c] for c in columns]))


def _counted(t: Table, columns: Sequence[str], summed: Sequence[str] = ()) -> DataFrame:
    figures, sums, names = [], [], []
    for i, c in enumerate(summed):
        figures.append(F.expr(f"CAST({quoted(c)} AS DOUBLE) AS k{i}"))
        sums += [F.sum(f"k{i}").alias(f"s{i}"), F.count(f"k{i}").alias(f"n{i}")]
        names += [f"s{i}", f"n{i}"]
    rows = t.df.select(*t.keys, *figures, unpivoted(t, columns, lambda c: f"CAST({quoted(c)} AS STRING)"))
    return (
        rows.where("value is not null")
        .groupBy(*t.keys, "position", "value")
        .agg(F.count(F.lit(1)).alias("n"), *sums)
        .select(*t.keys, "position", name_at(t, columns), "value", "n", *names)
    )
