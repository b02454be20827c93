"""Semantic column types and the schema profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.plans.table import Fact, Table, field, more_distinct_than, table


def temporal_strings(t: Table, columns: list[str]) -> set[str]:
    """String columns of whose first 100 values more than 80 % are dates."""
    columns = [c for c in columns if t.date_formats[c] is not None]
    samples = t.leading(columns, rules.DATE_SAMPLE, width=200)
    values = [(c, t.date_formats[c], v) for c, sample in samples.items() for v in sample]
    if not values:
        return set()
    read = F.try_to_timestamp("value", F.col("format")).isNotNull().cast("double")
    shares = (
        t.spark.createDataFrame(values, "name string, format string, value string")
        .groupBy("name")
        .agg(F.avg(read).alias("share"))
        .where(F.col("share") > rules.DATE_SHARE)
        .collect()
    )
    return {r["name"] for r in shares}


def declared(t: Table) -> dict[str, Fact]:
    """What the rules need to know of every column beside its distinct values.

    Ranges take the buffers of the moments' least and largest values.
    """
    wanted = {"rows": Fact(F.count(F.lit(1)), 1)}
    for c in t.columns:
        i, value, kind = t.position[c], field(c), t.kinds[c]
        wanted[f"n_{i}"] = Fact(F.count(value), 1)
        if kind in ("integer", "float", "decimal"):
            wanted[f"flag_{i}"] = Fact(F.bool_and(value.isin(0, 1)), 1)
        elif kind == "string":
            wanted[f"flag_{i}"] = Fact(F.bool_and(value.isin(*rules.BOOLEAN_WORDS)), 1)
            wanted[f"length_{i}"] = Fact(F.avg(F.length(value)), 2)
        if kind == "integer":
            wanted[f"range_{i}"] = Fact(F.max(value).cast("double") - F.min(value), 0)
    return wanted


def infer_types(df: DataFrame | Table) -> dict[str, str]:
    """Column name to semantic type; reads only what the rules cannot do without.

    An integer column can be an id only if it has more distinct values than half the
    rows. Where its range or its number of values already rules that out, and that is
    nearly always, nothing is counted; the other columns are decided by bounded sets of hashes.
    """
    t = table(df)
    if "types" in t.__dict__:
        return t.__dict__["types"]
    types = {c: "id" for c in t.columns if rules.named_like(c, rules.ID_NAME)}
    rest = [c for c in t.columns if c not in types]
    dates = temporal_strings(t, [c for c in rest if t.kinds[c] == "string"])

    wanted = declared(t)
    facts = (t.df.agg(*[f.value.alias(n) for n, f in wanted.items()]) if t.by else t.facts(wanted)).first()
    rows = facts["rows"]
    t.__dict__["rows"] = rows

    undecided = []
    for c in rest:
        i, kind = t.position[c], t.kinds[c]
        flag = facts[f"flag_{i}"] if kind not in ("boolean", "temporal") else None
        if kind == "boolean" or facts[f"n_{i}"] == 0:
            types[c] = "boolean"
        elif flag and (kind != "string" or (t.low_cardinality([c], 2)[c] or 3) <= 2):
            types[c] = "boolean"
        elif kind == "temporal" or c in dates:
            types[c] = "temporal"
        elif kind == "integer":
            possible = min(facts[f"n_{i}"], facts[f"range_{i}"] + 1)
            if possible > rules.HIGH_CARDINALITY and possible > rules.HIGH_CARDINALITY_RATIO * rows:
                undecided.append(c)
            else:
                types[c] = "numeric"
        elif kind in ("float", "decimal"):
            types[c] = "numeric"

    if undecided:
        limit = max(rules.HIGH_CARDINALITY_RATIO * rows, rules.HIGH_CARDINALITY)
        for c, many in more_distinct_than(t, undecided, limit).items():
            types[c] = "id" if many else "numeric"

    strings = [c for c in rest if c not in types]
    counts = t.low_cardinality(strings, rules.HIGH_CARDINALITY)
    for c in rest:
        if c in types:
            continue
        i = t.position[c]
        distinct = counts[c]
        if distinct is None or distinct / max(rows, 1) > rules.HIGH_CARDINALITY_RATIO:
            types[c] = "text" if facts[f"length_{i}"] > rules.TEXT_MEAN_LENGTH else "id"
        else:
            types[c] = "categorical"
    t.__dict__["types"] = {c: types[c] for c in t.columns}
    return t.__dict__["types"]


def sample_values(df: DataFrame | Table, n: int = 3) -> DataFrame:
    """(column, position, sample_values): the first ``n`` non-null values in row order."""
    t = table(df)
    values = t.leading(t.columns, n)
    return t.spark.createDataFrame(
        [(c, t.position[c], [str(v) for v in values[c]]) for c in t.columns],
        "column string, position int, sample_values array<string>",
    )


def schema_profile(df: DataFrame | Table) -> DataFrame:
    """One row per column with its semantic and physical type and first values.

    The result has one row per column of the input, nothing that grows with its rows.
    """
    t = table(df)
    types = infer_types(t)
    values = t.leading(t.columns, 3)
    return t.spark.createDataFrame(
        [
            (
                t.position[c],
                c,
                types[c],
                t.physical[c],
                [str(v) for v in values[c]],
                t.rows,
                len(t.columns),
            )
            for c in t.columns
        ],
        "position int, column string, inferred_type string, physical_type string, "
        "sample_values array<string>, row_count bigint, col_count int",
    )


def type_summary(df: DataFrame | Table) -> DataFrame:
    """Number of columns per semantic type; all six types are listed."""
    t = table(df)
    types = list(infer_types(t).values())
    return t.spark.createDataFrame(
        [(label, types.count(label)) for label in rules.SEMANTIC_TYPES],
        "inferred_type string, n_columns bigint",
    )
