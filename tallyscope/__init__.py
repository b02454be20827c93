"""Automatic table analysis on Spark: give any DataFrame, get typed analysis tables."""

from tallyscope.operators.analyze import Analysis, InputError, Limits, analyze, check_input
from tallyscope.operators.anomalies import (
    column_outliers,
    fences,
    outlier_examples,
    outlier_summary,
    suspicious_values,
    z_score_outliers,
)
from tallyscope.operators.categorical import categorical_summary, category_top_values
from tallyscope.operators.charts import (
    chart_area,
    chart_bar,
    chart_donut,
    chart_histogram,
    chart_line,
    chart_scatter,
    metric_comparison,
)
from tallyscope.operators.correlations import (
    collinearity,
    correlations,
    significant_pairs,
    top_correlations,
)
from tallyscope.operators.distributions import distributions, shapiro_wilk
from tallyscope.operators.findings import findings
from tallyscope.operators.kpis import kpis
from tallyscope.operators.numeric import numeric_summary
from tallyscope.operators.quality import (
    column_quality,
    constant_columns,
    duplicate_rows,
    table_quality,
)
from tallyscope.operators.schema import infer_types, sample_values, schema_profile, type_summary
from tallyscope.operators.segments import segment_insights, segments
from tallyscope.operators.temporal import (
    date_column,
    period_series,
    seasonality,
    time_grain,
    time_profile,
    trends,
)
from tallyscope.plans.table import Table
from tallyscope.session import session
from tallyscope.sources import file_info, read_csv, write_kpis, write_report, write_results

__all__ = [name for name in dir() if not name.startswith("_")]
