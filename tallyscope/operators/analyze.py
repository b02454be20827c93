"""Complete analyses: every result table of a quick or standard run."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope import rules
from tallyscope.operators import (
    anomalies,
    categorical,
    correlations,
    distributions,
    findings,
    kpis,
    numeric,
    quality,
    schema,
    segments,
    temporal,
)
from tallyscope.plans.moments import declared
from tallyscope.plans.table import Table


class InputError(ValueError):
    """The input cannot be analysed."""


def check_input(df: DataFrame) -> None:
    """At least one column and two rows; reads no more than two rows."""
    if not df.columns:
        raise InputError("the table has no columns")
    rows = len(df.take(2))
    if rows == 0:
        raise InputError("the table is empty")
    if rows < 2:
        raise InputError("at least 2 rows are needed for analysis")


@dataclass
class Analysis:
    """Named result tables; ``skipped`` says which parts failed, found nothing or left columns out."""

    table: Table
    depth: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[tuple[str, str, str]] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    @property
    def skipped(self) -> DataFrame:
        return self.table.spark.createDataFrame(
            self.notes, "name string, status string, reason string"
        )

    @property
    def warnings(self) -> DataFrame:
        """Quality warnings of the data, then a line for each skipped part."""
        parts = [
            self.table.spark.createDataFrame(
                [(reason,) for _, status, reason in self.notes if status != "limited"],
                "warning string",
            )
        ]
        if "table_quality" in self.tables:
            parts.insert(0, self["table_quality"].select(F.explode("warnings").alias("warning")))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete the result tables; they cannot be read afterwards."""
        self.table.release()


@dataclass(frozen=True)
class Limits:
    """How many columns, or rows of a result, an analysis takes; None takes all."""

    kpis: int | None = 10
    trend_metrics: int | None = rules.TREND_METRICS
    correlated_columns: int | None = rules.CORRELATED_COLUMNS
    segment_columns: int | None = rules.SEGMENT_COLUMNS
    segment_kpis: int | None = rules.SEGMENT_KPIS
    segments: int | None = segments.TOP_SEGMENTS
    findings: int | None = findings.KEPT


class Part:
    """Results of one chain of operators; a failing operator does not stop the others."""

    def __init__(self, t: Table, limits: Limits) -> None:
        self.t = t
        self.limits = limits
        self.tables: dict[str, DataFrame] = {}
        self.notes: list[tuple[str, str, str]] = []

    def first(self, name: str, columns: list[str], limit: int | None) -> list[str]:
        """The leading columns; those left out are noted."""
        if limit is not None and len(columns) > limit:
            self.notes.append((name, "limited", f"{name}: left out {', '.join(columns[limit:])}"))
        return columns[:limit]

    def add(
        self, name: str, compute: Callable[[], DataFrame | None], empty: str | None = None
    ) -> None:
        """Compute a table; with ``empty`` an empty one is noted with that sentence.

        The table is written here and now, so that whatever fails while it is read fails here, and
        so that it shows the input of this run.
        """
        try:
            result = compute()
            if result is not None and not self.t.is_kept(result):
                result = self.t.kept(f"part {name}", lambda made=result: made)
            nothing = result is None or (empty is not None and result.isEmpty())
        except Exception as error:  # noqa: BLE001 - reported, never hidden
            self.notes.append((name, "failed", f"{name} failed: {str(error).splitlines()[0]}"))
            return
        if result is not None:
            self.tables[name] = result
        if nothing and empty is not None:
            self.notes.append((name, "empty", empty))


def schema_part(t: Table, part: Part) -> None:
    if not t.by:
        part.add("schema_profile", lambda: schema.schema_profile(t))
        part.add("type_summary", lambda: schema.type_summary(t))
    part.add("kpis", lambda: t.kept("kpis", lambda: kpis.kpis(t, part.limits.kpis)))


def quality_part(t: Table, part: Part) -> None:
    part.add("column_quality", lambda: quality.column_quality(t))
    part.add("table_quality", lambda: t.kept("quality", lambda: quality.table_quality(t)))


def numeric_part(t: Table, part: Part) -> None:
    if t.numeric:
        part.add(
            "numeric_summary",
            lambda: t.kept("numeric", lambda: numeric.numeric_summary(t)),
            "Numeric columns exist but summary could not be computed",
        )


def categorical_part(t: Table, part: Part) -> None:
    if categorical.categorical_columns(t):
        part.add(
            "categorical_summary",
            lambda: t.kept("categorical", lambda: categorical.categorical_summary(t)),
        )
        part.add("category_top_values", lambda: categorical.category_top_values(t))


def shape_part(t: Table, part: Part) -> None:
    part.add(
        "distributions",
        lambda: t.kept("distributions", lambda: distributions.distributions(t))
        if t.numeric
        else None,
        "Distribution analysis skipped: insufficient numeric data",
    )
    no_numbers = "Anomaly detection skipped: insufficient data"
    if "distributions" not in part.tables:
        part.add("anomalies", lambda: None, no_numbers)
        return
    bounds = anomalies.fences(t, quartiles=part.tables["distributions"])
    part.add(
        "column_outliers",
        lambda: t.kept("outliers", lambda: anomalies.column_outliers(t, bounds=bounds)),
    )
    part.add("outlier_examples", lambda: anomalies.outlier_examples(t, bounds=bounds))
    part.add(
        "suspicious_values", lambda: t.kept("suspicious", lambda: anomalies.suspicious_values(t))
    )
    outliers = part.tables.get("column_outliers")
    if outliers is not None:
        part.add("outlier_summary", lambda: anomalies.outlier_summary(t, outliers=outliers))
    found = [part.tables.get(n) for n in ("column_outliers", "suspicious_values")]
    if all(df is not None and df.isEmpty() for df in found):
        part.notes.append(("anomalies", "empty", no_numbers))


def time_part(t: Table, part: Part) -> None:
    date_col = temporal.date_column(t)
    if date_col is None:
        part.add(
            "time_profile", lambda: None, "Temporal analysis skipped: no temporal columns detected"
        )
        return
    grain = t.kept("grain", lambda: temporal.time_grain(t, date_col))
    metrics = part.first("trends", t.numeric, part.limits.trend_metrics) if t.numeric else []
    daily = (temporal.daily_sums(t, date_col, metrics), 0) if metrics else None
    part.add(
        "time_profile",
        lambda: t.kept("time", lambda: temporal.time_profile(t, date_col=date_col, grain=grain, daily=daily)),
    )
    if metrics:
        sums = t.kept("period sums", lambda: temporal.period_sums(t, date_col, metrics, grain))
        part.add("period_series", lambda: temporal.period_series(t, sums=sums))
        part.add("trends", lambda: t.kept("trends", lambda: temporal.trends(t, sums=sums)))


def segment_part(t: Table, part: Part) -> None:
    columns, figures = segments.segment_columns(t), segments.segment_kpis(t)
    none = "Segmentation analysis skipped: no suitable categorical/numeric pairs"
    if not columns or not figures:
        part.add("segments", lambda: None, none)
        return
    columns = part.first("segments", columns, part.limits.segment_columns)
    figures = part.first("segments", figures, part.limits.segment_kpis)
    ranked = t.kept("segments", lambda: segments.all_segments(t, (), columns, figures))
    part.add("segments", lambda: segments.segments(t, ranked=ranked, top=part.limits.segments), none)
    part.add("segment_insights", lambda: segments.segment_insights(t, ranked=ranked))


def correlation_part(t: Table, part: Part) -> None:
    limit = part.limits.correlated_columns
    part.first("correlations", t.numeric, limit)
    part.add(
        "correlations",
        lambda: t.kept("correlations", lambda: correlations.correlations(t, limit))
        if len(t.numeric) >= 2
        else None,
        "Correlation analysis skipped: insufficient numeric columns",
    )
    pairs = part.tables.get("correlations")
    if pairs is not None:
        part.add("collinearity", lambda: correlations.collinearity(t, pairs=pairs))


QUICK = (schema_part, quality_part, numeric_part, categorical_part)
STANDARD = (*QUICK, shape_part, time_part, segment_part, correlation_part)


def analyze(
    df: DataFrame, depth: str = "standard", by: Sequence[str] = (), limits: Limits = Limits()
) -> Analysis:
    """Run a quick or standard analysis; one failing part does not stop the others.

    The parts do not depend on each other, so their Spark jobs are submitted together and
    share the cluster; what several parts need is computed once, beforehand or by whoever
    asks first. Results are tables in the shared folder, made anew by every call; they go with
    ``close()``, or as a context manager's block or the process ends.
    """
    if depth not in ("quick", "standard"):
        raise ValueError(f"depth must be quick or standard, not {depth!r}")
    t = Table(df, by, keep=True)
    if not t.columns or len(t.top(2)) < 2:
        check_input(df)
    t.summed = segments.segment_kpis(t)[: limits.segment_kpis]
    run = Analysis(t, depth)
    chains = STANDARD if depth == "standard" else QUICK
    # What is known to be needed from the schema alone is gathered in shared scans.
    t.declare(schema.declared(t) | quality.declared(t) | declared(t) | temporal.declared(t))
    first = Part(t, limits)
    first.add("types", lambda: schema.infer_types(t) and None)
    run.notes.extend(first.notes)
    with ThreadPoolExecutor(max_workers=len(chains)) as pool:
        for part in pool.map(lambda chain: run_part(chain, t, limits), chains):
            run.tables.update(part.tables)
            run.notes.extend(part.notes)
    last = Part(t, limits)
    last.add("findings", lambda: findings.findings(run.tables, depth, t.by, limits.findings))
    run.tables.update(last.tables)
    run.notes.extend(last.notes)
    return run


def run_part(chain: Callable[[Table, Part], None], t: Table, limits: Limits) -> Part:
    part = Part(t, limits)
    try:
        chain(t, part)
    except Exception as error:  # noqa: BLE001 - reported, never hidden
        part.notes.append((chain.__name__, "failed", str(error).splitlines()[0]))
    return part
