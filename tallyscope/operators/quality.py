"""Data quality: missing values, complete rows, duplicates, constants, overall score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import finite_or, fixed
from tallyscope.plans.shared import written
from tallyscope.plans.table import Fact, Table, field, inlined, join_on, quoted, table, text

# Up to this many repeated row hashes (8 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000


def declared(t: Table) -> dict[str, Fact]:
    """The number of rows, of complete ones, and per column of values, and whether these are all the same.

    Text is compared through its 64-bit hash (a column of different texts would have to collide in
    all its rows to be called constant): fixed-width buffers keep the aggregation in
    Spark's hash aggregate, where the texts themselves would force a sort per group.
    """
    complete = F.expr(" AND ".join(f"{quoted(c)} IS NOT NULL" for c in t.columns))
    wanted = {"rows": Fact(F.count(F.lit(1)), 1), "complete": Fact(F.count_if(complete), 1)}
    for name in t.columns:
        i, c = t.position[name], quoted(name)
        value = f"IF({c} IS NULL, NULL, xxhash64({c}))" if t.kinds[name] == "string" else c
        wanted[f"n_{i}"] = Fact(F.count(field(name)), 1)
        # Of numbers these are the buffers of the moments.
        wanted[f"same_{i}"] = Fact(F.expr(f"min({value}) <=> max({value})"), 0 if name in t.numeric else 2)
    return wanted


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def column_quality(df: DataFrame | Table, by: Sequence[str] = ()) -> DataFrame:
    """(keys, position, column, missing_count, missing_pct, is_flagged, is_constant)."""
    t = table(df, by)
    rows = inlined(
        [
            {
                "position": t.position[c],
                "column": text(c),
                "missing_count": f"rows - n_{t.position[c]}",
                "is_constant": f"same_{t.position[c]}",
                "__total": "rows",
            }
            for c in t.columns
        ]
    )
    found = t.facts(declared(t)).select(*t.keys, rows).where("__total > 0")
    missing = pct(F.col("missing_count"), F.col("__total"))
    return found.select(
        *t.keys,
        "position",
        "column",
        "missing_count",
        missing.alias("missing_pct"),
        (missing > rules.MISSING_FLAG_PCT).alias("is_flagged"),
        "is_constant",
    )


def constant_columns(df: DataFrame | Table, by: Sequence[str] = ()) -> DataFrame:
    t = table(df, by)
    return column_quality(t).where("is_constant").select(*t.keys, "position", "column")


def duplicate_rows(
    df: DataFrame | Table, by: Sequence[str] = (), broadcast_hashes: int = BROADCAST_HASHES
) -> DataFrame:
    """(keys, duplicate_rows): rows equal to an earlier row, nulls equal to each other.

    Only digests are shuffled: 64-bit ones of all rows, and SHA-256 ones of those rows whose first
    digest occurs more than once. No two different rows are known that share the latter.
    """
    t = table(df, by)
    columns = t.df.columns
    hashed = [
        field(c) + 0.0 if t.kinds[c] == "float" else field(c) for c in columns
    ]  # -0.0 and 0.0 are equal values
    rows = t.df.withColumn("__hash", F.xxhash64(*hashed))
    repeated = written(
        rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__hash"),
        "repeated",
    )
    suspects = repeated.count()
    if suspects <= broadcast_hashes:
        repeated = F.broadcast(repeated)
    # Without a repeated hash the table need not be read again.
    rows = rows.join(repeated, "__hash", "left_semi") if suspects else rows.where(F.lit(False))
    # Every value with its length, so that rows read alike only if all their values are alike.
    texts = [h.cast("string") for h in hashed]
    spelled = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]
    whole = F.unhex(F.sha2(F.concat(*spelled), 256)).alias("__whole")
    copies = rows.groupBy(*t.keys, whole).agg((F.count(F.lit(1)) - 1).alias("n"))
    counted = copies.groupBy(*t.keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"))
    if not t.by:
        return counted
    groups = t.df.groupBy(*t.keys).agg(F.lit(0).cast("bigint").alias("none"))
    return join_on(groups, counted, t.by, "left").select(
        *t.keys, F.coalesce("duplicate_rows", "none").alias("duplicate_rows")
    )


def name_list(names: Column) -> Column:
    """First five names, and how many more there are."""
    shown = F.array_join(F.slice(names, 1, 5), ", ")
    more = F.when(F.size(names) > 5, F.format_string(" and %d more", F.size(names) - 5))
    return F.concat(shown, F.coalesce(more, F.lit("")))


def table_quality(df: DataFrame | Table, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: missing cells, complete rows, duplicates, warnings and score."""
    t = table(df, by)
    structs = [
        f"struct({text(c)} AS column, rows - n_{t.position[c]} AS missing, same_{t.position[c]} AS same)"
        for c in t.columns
    ]
    facts = F.expr(f"array({', '.join(structs)})")
    counted = t.facts(declared(t)).select(*t.keys, "rows", "complete", facts.alias("facts"))
    copies = duplicate_rows(t)
    if t.by:
        counted = join_on(counted, copies, t.by)
    else:
        counted = counted.withColumn("duplicate_rows", F.lit(copies.first()["duplicate_rows"]))
    width = len(t.columns)
    flagged = F.filter(
        "facts", lambda f: pct(f["missing"], F.col("rows")) > rules.MISSING_FLAG_PCT
    )
    constant = F.filter("facts", lambda f: f["same"])
    measured = counted.select(
        *t.keys,
        "rows",
        F.aggregate("facts", F.lit(0).cast("bigint"), lambda a, f: a + f["missing"]).alias(
            "total_missing_cells"
        ),
        (F.col("rows") * width).alias("total_cells"),
        pct(F.col("complete"), F.col("rows")).alias("complete_rows_pct"),
        "duplicate_rows",
        pct(F.col("duplicate_rows"), F.col("rows")).alias("duplicate_pct"),
        flagged["column"].alias("flagged"),
        constant["column"].alias("constant"),
    ).withColumn("missing_pct", pct(F.col("total_missing_cells"), F.col("total_cells")))
    warnings = F.array_compact(
        F.array(
            F.when(
                F.size("flagged") > 0,
                F.concat(F.lit("High missing values (>5%) in: "), name_list(F.col("flagged"))),
            ),
            F.when(
                F.col("complete_rows_pct") < rules.COMPLETE_ROWS_PCT,
                F.format_string(
                    "Only %s%% of rows are complete (no missing values)",
                    fixed(F.col("complete_rows_pct"), 1),
                ),
            ),
            F.when(
                F.col("duplicate_pct") > rules.DUPLICATE_PCT,
                F.format_string(
                    "%d duplicate rows detected (%s%%)",
                    "duplicate_rows",
                    fixed(F.col("duplicate_pct"), 1),
                ),
            ),
            F.when(
                F.size("constant") > 0,
                F.concat(
                    F.lit("Constant columns (no analytical value): "), name_list(F.col("constant"))
                ),
            ),
        )
    )
    score = (
        0.35 * F.greatest(F.lit(0.0), 1 - F.col("missing_pct") / 100)
        + 0.35 * F.col("complete_rows_pct") / 100
        + 0.15 * F.greatest(F.lit(0.0), 1 - F.col("duplicate_pct") / 100 * 10)
        + 0.15 * (1 - F.size("constant") / F.lit(float(max(width, 1))))
    )
    empty = F.col("rows") == 0
    return measured.select(
        *t.keys,
        F.when(empty, 0.0).otherwise(finite_or(score, 0.0)).alias("overall_score"),
        "total_missing_cells",
        "total_cells",
        "missing_pct",
        "complete_rows_pct",
        "duplicate_rows",
        F.when(empty, F.lit(0)).otherwise(F.size("constant")).alias("constant_columns"),
        F.when(empty, F.array(F.lit("DataFrame is empty"))).otherwise(warnings).alias("warnings"),
    )
