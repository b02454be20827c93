"""Writing result tables, the key figures, and a report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(results: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Every table to its own folder below ``path``."""
    for name, df in results.items():
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def write_kpis(kpis: DataFrame, path: str) -> None:
    """name, value and formatted_value as CSV; a range has its text as value."""
    keys = kpis.columns[: kpis.columns.index("rank")]
    value = F.coalesce("text_value", F.col("value").cast("string"))
    rows = kpis.select(*keys, "rank", "name", value.alias("value"), "formatted_value")
    rows.orderBy(*keys, "rank").drop("rank").write.mode("overwrite").option("header", True).csv(path)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as Markdown sections, in order."""
    keys = findings.columns[: findings.columns.index("rank")]
    section = F.format_string("### %s\n%s\n", "title", "body").alias("value")
    findings.orderBy(*keys, "rank").select(section).write.mode("overwrite").text(path)
