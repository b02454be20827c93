"""Findings: one sentence per notable result, ranked."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.labels import fixed
from tallyscope.plans.table import field, join_on

# Scores that decide the ranking.
SEVERITY_SCORES = {"warning": 100, "positive": 80, "info": 50}
CATEGORY_SCORES = {
    "anomaly": 90,
    "trend": 85,
    "correlation": 70,
    "segmentation": 65,
    "distribution": 50,
    "kpi": 45,
    "quality": 40,
}
OTHER_CATEGORY = 30
KEPT = 15
QUALITY_ALERT = 0.8


def thousands(c: Column) -> Column:
    return fixed(c, 0, ",")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of every group of a result table, numbered in ``place``."""
    keys = [field(k) for k in by] or [F.lit(0)]
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)


def finding(
    df: DataFrame,
    by: Sequence[str],
    part: int,
    title: Column,
    body: Column,
    severity: Column,
    category: str,
    source: Column,
) -> DataFrame:
    """Rows of a result table as findings; ``part`` keeps the order of the generators."""
    details = [field(c) for c in df.columns if c not in by and c != "place"]
    return df.select(
        *[field(k) for k in by],
        (F.lit(part * 100) + F.col("place")).alias("seq"),
        title.alias("title"),
        body.alias("body"),
        severity.alias("severity"),
        F.lit(category).alias("category"),
        source.alias("source_key"),
        F.to_json(F.struct(*details)).alias("supporting_data"),
    )


def kpi_findings(kpis: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(kpis, by, [F.col("rank")], 5)
    body = F.format_string("**%s** detected as a key metric in your data.", "formatted_value")
    return finding(
        rows, by, 1, F.col("name"), body, F.lit("info"), "kpi", F.col("source_column")
    )


def numeric_findings(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(summary, by, [F.col("position")], 3)
    mean, median, c = F.col("mean"), F.col("median"), F.col("column")
    apart = F.coalesce(F.abs(F.try_divide(mean - median, mean)) > 0.2, F.lit(False))
    diverging = F.format_string(
        "`%s` shows **%s** distribution (mean: %s, median: %s). "
        "Consider using median for typical values.",
        c, "skew_interpretation", fixed(mean, 2), fixed(median, 2),
    )
    plain = F.format_string(
        "`%s` has mean **%s** with %s distribution.", c, fixed(mean, 2), "skew_interpretation"
    )
    return finding(
        rows, by, 2, F.concat(F.lit("Distribution: "), c),
        F.when(apart, diverging).otherwise(plain),
        F.when(apart, "warning").otherwise("info"), "distribution", c,
    )


def categorical_findings(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(summary, by, [F.col("position")], 3).where("not is_high_cardinality")
    c = F.col("column")
    high = F.col("concentration") == "high"
    concentrated = F.format_string(
        "`%s` is **highly concentrated**: '%s' accounts for %s%% of data. "
        "Consider whether this reflects reality or sampling bias.",
        c, "top_value", fixed(F.col("top_pct"), 1),
    )
    plain = F.format_string(
        "`%s` has %d unique values. Most common: '%s' (%s%%).",
        c, "cardinality", "top_value", fixed(F.col("top_pct"), 1),
    )
    return finding(
        rows, by, 3, F.concat(F.lit("Segments: "), c),
        F.when(high, concentrated).otherwise(plain),
        F.when(high, "warning").otherwise("info"), "segmentation", c,
    )


def distribution_findings(distributions: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(distributions, by, [F.col("position")], 3)
    c, label = F.col("column"), F.col("distribution_type")
    normal = F.format_string(
        "`%s` follows a **normal distribution**. The middle 50%% of values fall between %s and %s.",
        c, fixed(F.col("q1"), 2), fixed(F.col("q3"), 2),
    )
    skewed = F.format_string(
        "`%s` is **%s**. The middle 50%% of values (IQR: %s) may not represent the typical "
        "value well.", c, label, fixed(F.col("iqr"), 2),
    )
    other = F.format_string(
        "`%s` has a **%s** distribution. IQR: %s.", c, label, fixed(F.col("iqr"), 2)
    )
    lopsided = label.isin("right-skewed", "left-skewed")
    return finding(
        rows, by, 2, F.concat(F.lit("Distribution: "), c),
        F.when(F.col("is_normal"), normal).when(lopsided, skewed).otherwise(other),
        F.when(~F.col("is_normal") & lopsided, "warning").otherwise("info"), "distribution", c,
    )


def trend_findings(trends: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(trends, by, [F.col("position")], 2)
    metric, direction = F.col("metric"), F.col("direction")
    speed = fixed(F.abs("slope_pct"), 1)
    up = F.format_string("**%s** is trending **up** at %s%% per period.", metric, speed)
    down = F.format_string("**%s** is trending **down** at %s%% per period.", metric, speed)
    flat = F.format_string("**%s** is **stable** with no significant trend.", metric)
    change = F.format_string(
        " Latest period change: %s%%.", fixed(F.col("change_pct"), 1, "+")
    )
    body = F.when(direction == "increasing", up).when(direction == "decreasing", down)
    severity = F.when(direction == "increasing", "positive").when(
        direction == "decreasing", "warning"
    )
    return finding(
        rows, by, 3, F.concat(F.lit("Trend: "), metric), F.concat(body.otherwise(flat), change),
        severity.otherwise("info"), "trend", metric,
    )


def season_findings(profile: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = profile.where("seasonality_detected").withColumn("place", F.lit(50))
    body = F.format_string(
        "**%s**. Seasonal variation coefficient: %s%%. Consider this in forecasting.",
        "pattern", fixed(F.col("cv"), 1),
    )
    return finding(
        rows, by, 3, F.lit("Seasonality Detected"), body, F.lit("info"), "seasonality",
        F.col("date_column"),
    )


def segment_findings(insights: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = first_rows(insights, by, [F.col("segment_position"), F.col("kpi_position")], 2)
    wide = F.coalesce(F.col("performance_spread") > 2, F.lit(False))
    top, bottom = thousands(F.col("top_kpi")), thousands(F.col("bottom_kpi"))
    gap = F.format_string(
        "**%s** leads in `%s` (%s) — **%sx** higher than **%s** (%s). "
        "Large performance gap warrants investigation.",
        "top_value", "kpi_column", top, fixed(F.col("performance_spread"), 1), "bottom_value",
        bottom,
    )
    plain = F.format_string(
        "**%s** leads `%s` (%s), while **%s** trails (%s).",
        "top_value", "kpi_column", top, "bottom_value", bottom,
    )
    return finding(
        rows, by, 4, F.concat(F.lit("Segment Performance: "), F.col("segment_column")),
        F.when(wide, gap).otherwise(plain), F.when(wide, "warning").otherwise("info"),
        "segmentation", F.col("segment_column"),
    )


def correlation_findings(correlations: DataFrame, by: Sequence[str]) -> DataFrame:
    order = [F.desc(F.abs("r")), F.col("position_a"), F.col("position_b")]
    rows = first_rows(correlations.where("is_significant"), by, order, 2)
    r, a, b = F.col("r"), F.col("column_a"), F.col("column_b")
    sign = F.when(r > 0, "positive").otherwise("negative")
    strong = F.format_string(
        "**Strong %s correlation** (r=%s) between `%s` and `%s`. "
        "Changes in one likely reflect in the other.", sign, fixed(r, 2), a, b,
    )
    moderate = F.format_string(
        "**Moderate %s correlation** (r=%s) between `%s` and `%s`.", sign, fixed(r, 2), a, b
    )
    pairs = finding(
        rows, by, 5, F.format_string("Correlation: %s ↔ %s", a, b),
        F.when(F.abs(r) >= 0.7, strong).otherwise(moderate), F.lit("info"), "correlation",
        F.concat_ws("|", a, b),
    )
    collinear = first_rows(correlations.where("is_collinear"), by, order, 1)
    warning = finding(
        collinear, by, 5, F.lit("⚠️ Multicollinearity Warning"),
        F.lit("Some variables are **highly correlated (r > 0.9)**. This may cause issues in "
              "predictive modeling. Consider removing redundant features."),
        F.lit("warning"), "correlation", F.lit("multicollinearity"),
    ).withColumn("seq", F.col("seq") + 50)
    return pairs.unionByName(warning)


def anomaly_findings(
    summary: DataFrame, outliers: DataFrame, suspicious: DataFrame, by: Sequence[str]
) -> DataFrame:
    total = summary.where("total_outliers > 0").withColumn("place", F.lit(1))
    many = F.col("outlier_pct") > 5
    head = F.format_string(
        "**%,d outliers** detected (%s%% of data). ",
        "total_outliers", fixed(F.col("outlier_pct"), 1),
    )
    advice = F.when(many, "This is unusually high — verify data quality.").otherwise(
        "Review for data entry errors or genuine extremes."
    )
    overall = finding(
        total, by, 6, F.lit("Outlier Summary"), F.concat(head, advice),
        F.when(many, "warning").otherwise("info"), "anomaly", F.lit("outliers"),
    )
    c = F.col("column")
    side = (
        F.when(F.col("direction") == "high", "above normal")
        .when(F.col("direction") == "low", "below normal")
        .otherwise("above and below normal")
    )
    worst = finding(
        first_rows(outliers, by, [F.desc("outlier_count"), F.col("position")], 1), by, 6,
        F.concat(F.lit("Outliers: "), c),
        F.format_string(
            "`%s` has **%d outliers** (%s). Verify these are valid data points.",
            c, "outlier_count", side,
        ),
        F.lit("warning"), "anomaly", c,
    ).withColumn("seq", F.col("seq") + 10)
    zeros = F.format_string(
        "**%d zero values** in `%s` — unexpected for this type of metric.", "count", c
    )
    negatives = F.format_string(
        "**%d negative values** in `%s` — may indicate returns, corrections, or errors.",
        "count", c,
    )
    alert = finding(
        first_rows(suspicious, by, [F.col("position"), F.desc("issue")], 1), by, 6,
        F.concat(F.lit("Data Alert: "), c),
        F.when(F.col("issue") == "unexpected_zeros", zeros).otherwise(negatives),
        F.lit("warning"), "anomaly", c,
    ).withColumn("seq", F.col("seq") + 20)
    return overall.unionByName(worst).unionByName(alert)


def quality_findings(quality: DataFrame, by: Sequence[str]) -> DataFrame:
    rows = quality.where(F.col("overall_score") < QUALITY_ALERT).withColumn("place", F.lit(1))
    advice = F.coalesce(F.get("warnings", F.lit(0)), F.lit("Review data before making decisions."))
    body = F.format_string(
        "Data quality score: **%s%%**. %s%% of cells are missing. %s",
        fixed(F.col("overall_score") * 100, 0), fixed(F.col("missing_pct"), 1), advice,
    )
    return finding(
        rows, by, 7, F.lit("Data Quality Alert"), body, F.lit("warning"), "quality",
        F.lit("quality"),
    )


def scores(spark) -> DataFrame:
    """Every (severity, category) with a score of its own; a constant table."""
    return spark.createDataFrame(
        [
            (s, c, a + b)
            for s, a in SEVERITY_SCORES.items()
            for c, b in {**CATEGORY_SCORES, None: OTHER_CATEGORY}.items()
        ],
        "severity string, known string, score int",
    )


def ranked(found: DataFrame, by: Sequence[str], kept: int | None = KEPT) -> DataFrame:
    """Highest score first, in generator order among equals, ``kept`` per group (None: all)."""
    known = F.when(F.col("category").isin(*CATEGORY_SCORES), F.col("category"))
    scored = join_on(
        found.withColumn("known", known), F.broadcast(scores(found.sparkSession)),
        ["severity", "known"],
    )
    keys = [field(k) for k in by] or [F.lit(0)]
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "seq")
    scored = scored.withColumn("rank", F.row_number().over(order))
    return scored if kept is None else scored.where(F.col("rank") <= kept)


COLUMNS = ("rank", "title", "body", "severity", "category", "score", "source_key", "supporting_data")


def findings(
    results: Mapping[str, DataFrame],
    depth: str = "standard",
    by: Sequence[str] = (),
    kept: int | None = KEPT,
) -> DataFrame:
    """Findings over the result tables of an analysis; tables that are missing are skipped.

    The work grows with groups times columns, not with the rows that were analysed.
    """
    have = {k: v for k, v in results.items() if v is not None}
    parts = []
    if "kpis" in have:
        parts.append(kpi_findings(have["kpis"], by))
    if depth == "quick":
        if "numeric_summary" in have:
            parts.append(numeric_findings(have["numeric_summary"], by))
        if "categorical_summary" in have:
            parts.append(categorical_findings(have["categorical_summary"], by))
    else:
        if "distributions" in have:
            parts.append(distribution_findings(have["distributions"], by))
        if "trends" in have:
            parts.append(trend_findings(have["trends"], by))
        if "time_profile" in have:
            parts.append(season_findings(have["time_profile"], by))
        if "segment_insights" in have:
            parts.append(segment_findings(have["segment_insights"], by))
        if "correlations" in have:
            parts.append(correlation_findings(have["correlations"], by))
        if {"outlier_summary", "column_outliers", "suspicious_values"} <= have.keys():
            parts.append(
                anomaly_findings(
                    have["outlier_summary"], have["column_outliers"], have["suspicious_values"], by
                )
            )
    if "table_quality" in have:
        parts.append(quality_findings(have["table_quality"], by))
    found = reduce(DataFrame.unionByName, parts)
    keys = [field(k) for k in by]
    if depth == "quick":
        order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("seq")
        numbered = ranked(found, by, kept=None).withColumn("rank", F.row_number().over(order))
        return numbered.select(*keys, *COLUMNS)
    return ranked(found, by, kept).select(*keys, *COLUMNS)
