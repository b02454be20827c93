"""Key figures chosen by column type and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.functions.labels import human_number
from tallyscope.operators.schema import infer_types
from tallyscope.operators.temporal import date_facts
from tallyscope.plans.histogram import value_counts
from tallyscope.plans.moments import fact
from tallyscope.plans.table import Fact, Table, inlined, join_on, table, text

SEGMENT_RANGE = (2, 50)


def entry(
    name: str,
    value: str,
    source: str,
    computation: str,
    confidence: float,
    valid: str = "true",
    currency: str = "false",
    whole: bool = False,
    shown: str = "CAST(NULL AS STRING)",
    words: str = "CAST(NULL AS STRING)",
) -> dict[str, object]:
    """One candidate as SQL; ``shown`` replaces the usual number format."""
    return {
        "name": text(name),
        "value": f"CAST({value} AS DOUBLE)",
        "text_value": words,
        "shown": shown,
        "currency": currency,
        "whole": str(whole).lower(),
        "source_column": source,
        "computation": text(computation),
        "confidence": f"{confidence!r}D",
        "valid": valid,
    }


def number_entries(t: Table, types: dict[str, str]) -> tuple[dict[str, Fact], list[dict]]:
    """Aggregates and candidates for numeric columns that look like money or counts."""
    wanted, entries = {}, []
    for c in [c for c in t.columns if types[c] == "numeric"]:
        i, title = t.position[c], rules.display_name(c)
        if rules.named_like(c, rules.REVENUE_NAME):
            wanted |= dict(fact(stat, t, c) for stat in ("sum", "mean", "min", "n"))
            name = c.lower()
            if "revenue" in name or "amount" in name:
                currency = "true"
            else:
                currency = f"coalesce(min_{i} >= 0, false)" if "price" in name else "false"
            kind = {"source": text(c), "valid": f"n_{i} > 0", "currency": currency}
            entries.append(entry(f"Total {title}", f"sum_{i}", computation="sum", confidence=0.85, **kind))
            entries.append(entry(f"Avg {title}", f"mean_{i}", computation="mean", confidence=0.80, **kind))
        elif rules.named_like(c, rules.COUNT_NAME):
            wanted |= dict(fact(stat, t, c) for stat in ("sum", "n"))
            entries.append(
                entry(f"Total {title}", f"round(sum_{i}, 6) - round(sum_{i}, 6) % 1", text(c), "sum", 0.80,
                      valid=f"n_{i} > 0", whole=True)
            )
    return wanted, entries


def kpis(df: DataFrame | Table, limit: int | None = 10, by: Sequence[str] = ()) -> DataFrame:
    """The ``limit`` most trusted key figures (None: all), ranked, one scan for all of them."""
    t = table(df, by)
    types = infer_types(t)
    entries = [
        entry("Total Records", "rows", "'_rows_'", "count", 1.0, valid="rows > 0", whole=True)
    ]
    wanted, found = number_entries(t, types)
    entries += found
    wanted["rows"] = Fact(F.count(F.lit(1)), 1)

    dates = [c for c in t.columns if types[c] == "temporal"]
    for c in dates:
        wanted |= date_facts(t, c)
    if dates:
        ranges = [
            f"IF(first_{i} IS NULL, NULL, struct({text(c)} AS name, first_{i} AS a, last_{i} AS b))"
            for c, i in ((c, t.position[c]) for c in dates)
        ]
        span = "timestampdiff(DAY, dates.a, dates.b)"
        words = "concat(date_format(dates.a, 'MMM yyyy'), ' – ', date_format(dates.b, 'MMM yyyy'))"
        kind = {"source": "dates.name", "computation": "range", "confidence": 0.95}
        kind["valid"] = "dates IS NOT NULL"
        entries += [
            entry("Date Range", "NULL", shown=words, words=words, **kind),
            entry("Time Span", span, shown=f"concat({span}, ' days')", **kind),
        ]

    categories = [c for c in t.columns if types[c] == "categorical"]
    known = {} if t.by else t.low_cardinality(categories, rules.HIGH_CARDINALITY)
    low, high = SEGMENT_RANGE
    for c in categories:
        n = f"coalesce(cardinality[{text(c)}], 0L)" if t.by else f"{known[c] or 0}L"
        entries.append(
            entry(f"Unique {rules.display_name(c)}s", n, text(c), "count", 0.70,
                  valid=f"{n} BETWEEN {low} AND {high}", shown=f"CAST({n} AS STRING)")
        )

    measured = t.facts(wanted)
    if dates:
        measured = measured.withColumn("dates", F.expr(f"coalesce({', '.join(ranges)})"))
    if t.by and categories:
        counts = (
            value_counts(t, categories)
            .groupBy(*t.keys, "column")
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*t.keys)
            .agg(F.map_from_entries(F.collect_list(F.struct("column", "n"))).alias("cardinality"))
        )
        measured = join_on(measured, counts, t.by, "left")
    rows = measured.select(
        *t.keys, inlined([{"seq": i} | e for i, e in enumerate(entries)])
    ).where("valid")
    # Bounded windows: at most a few entries per input column and group.
    order = [F.desc("confidence"), F.col("seq")]
    same_name = Window.partitionBy(*t.keys, "name").orderBy(*order)
    group = Window.partitionBy(*(t.keys or [F.lit(0)])).orderBy(*order)
    shown = F.coalesce("shown", human_number(F.col("value"), F.col("currency"), F.col("whole")))
    return (
        rows.withColumn("copy", F.row_number().over(same_name))
        .where("copy = 1")
        .withColumn("rank", F.row_number().over(group))
        .where(F.lit(True) if limit is None else F.col("rank") <= limit)
        .select(
            *t.keys, "rank", "name", "value", "text_value", shown.alias("formatted_value"),
            "source_column", "computation", "confidence",
        )
    )
