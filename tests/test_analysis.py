import numpy as np
import pytest
from pyspark.sql import functions as F

import tallyscope as ts
from tests.conftest import by_key, rows


def test_quick_findings(sales):
    run = ts.analyze(sales, "quick")
    found = rows(run["findings"], "rank")
    assert [r["title"] for r in found] == [
        "Total Records", "Date Range", "Time Span", "Total Revenue", "Avg Revenue",
        "Distribution: revenue", "Distribution: units_sold", "Distribution: discount_pct",
        "Segments: date", "Segments: region", "Segments: product",
    ]
    bodies = {r["title"]: r["body"] for r in found}
    assert bodies["Total Revenue"] == "**$42.1K** detected as a key metric in your data."
    assert bodies["Distribution: units_sold"] == "`units_sold` has mean **42.05** with symmetric distribution."
    assert bodies["Segments: region"] == "`region` has 4 unique values. Most common: 'North' (30.0%)."
    assert run.skipped.count() == 0
    run.close()


def test_standard_findings(sales):
    run = ts.analyze(sales)
    found = rows(run["findings"], "rank")
    assert [(r["title"], r["score"]) for r in found[:4]] == [
        ("Segment Performance: date", 165), ("Segment Performance: date", 165),
        ("Trend: revenue", 135), ("Trend: units_sold", 135),
    ]
    assert found[2]["body"] == (
        "**revenue** is **stable** with no significant trend. Latest period change: -67.5%."
    )
    assert found[0]["body"] == (
        "**2025-01-06** leads in `revenue` (6,100) — **3.3x** higher than **2025-01-10** (1,850). "
        "Large performance gap warrants investigation."
    )
    skipped = {r["reason"] for r in run.skipped.where("status <> 'limited'").collect()}
    assert skipped == {
        "Distribution analysis skipped: insufficient numeric data",
        "Correlation analysis skipped: insufficient numeric columns",
        "Anomaly detection skipped: insufficient data",
    }
    assert {r["warning"] for r in run.warnings.collect()} == skipped


def test_all_finding_kinds(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 400
    day = pd.date_range("2023-01-01", periods=n, freq="D")
    base = np.linspace(1000, 1400, n) + rng.normal(0, 5, n)
    base[day.month == 12] *= 3
    price = rng.exponential(10, n)
    price[:3] = [-5, -1, 0]
    frame = pd.DataFrame({"day": day, "sales": base, "sales_twice": base * 2, "price": price})
    frame["kind"] = np.where(np.arange(n) % 10 == 0, "rare", "often")
    frame["gap"] = [None if i % 2 else 1.0 for i in range(n)]
    frame["gap2"] = [None if i % 3 else 1.0 for i in range(n)]
    run = ts.analyze(spark.createDataFrame(frame))
    found = by_key(run["findings"], "title")
    assert found["⚠️ Multicollinearity Warning"]["score"] == 170
    assert found["Correlation: sales ↔ sales_twice"]["body"].startswith("**Strong positive correlation** (r=1.00)")
    season = by_key(ts.findings({"time_profile": run["time_profile"]}), "title")
    assert season["Seasonality Detected"]["score"] == 80
    assert season["Seasonality Detected"]["body"].startswith("**Dec typically highest**.")
    assert found["Data Alert: price"]["body"].startswith("**1 zero values** in `price`")
    assert found["Segment Performance: kind"]["severity"] == "warning"
    assert found["Data Quality Alert"]["score"] == 140
    assert "Outliers: sales" in found and run["findings"].count() == 15
    scores = [r["score"] for r in rows(run["findings"], "rank")]
    assert scores == sorted(scores, reverse=True)


def test_per_group_equals_group_alone(sales):
    by_region = ts.analyze(sales, by=["region"])
    alone = ts.analyze(sales.where("region = 'North'").drop("region"), "quick")
    got = by_key(by_region["kpis"].where("region = 'North'"), "name")
    want = by_key(alone["kpis"], "name")
    for name in ("Total Records", "Total Revenue", "Total Units Sold", "Time Span"):
        assert got[name]["value"] == want[name]["value"]
    ranks = by_region["findings"].groupBy("region").agg(F.max("rank").alias("m"), F.count("*").alias("n"))
    assert all(r["m"] == r["n"] for r in ranks.collect())


def test_one_failing_part_is_reported(sales, monkeypatch):
    from tallyscope.operators import correlations

    def broken(*_args, **_kwargs):
        raise RuntimeError("no correlation today")

    monkeypatch.setattr(correlations, "correlations", broken)
    run = ts.analyze(sales)
    notes = by_key(run.skipped, "name")
    assert notes["correlations"]["status"] == "failed"
    assert "no correlation today" in notes["correlations"]["reason"]
    assert "correlations" not in run and run["findings"].count() > 0


def test_input_checks(spark):
    for data in ([], [(1,)]):
        with pytest.raises(ts.InputError):
            ts.analyze(spark.createDataFrame(data, "a int"))
    with pytest.raises(ValueError, match="depth"):
        ts.analyze(spark.range(3), "deep")
    with pytest.raises(ValueError, match="group keys"):
        ts.analyze(spark.range(3), by=["nope"])


def test_text_only_table(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "y")], "p string, q string")
    run = ts.analyze(df)
    assert "trends" not in run and run["kpis"].count() >= 1
    assert "no temporal columns" in " ".join(r["reason"] for r in run.skipped.collect())


def test_finite_or_null(spark):
    from tallyscope.functions import finite_or_null

    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (2.5, 3)], "x double, k int")
    assert [r["x"] for r in rows(finite_or_null(df), "k")] == [None, None, 2.5]


def test_charts(spark, sales):
    bars = [(r["x"], r["y"]) for r in ts.chart_bar(sales, "product", "revenue").collect()]
    assert bars == [("Widget C", 15100.0), ("Widget B", 14800.5), ("Widget A", 12150.0)]
    counts = [(r["x"], r["y"]) for r in ts.chart_bar(sales, "product").collect()]
    assert counts == [("Widget A", 8), ("Widget B", 7), ("Widget C", 5)]
    line = ts.chart_line(sales, "date", "revenue").collect()
    assert len(line) == 10 and line[0]["y"] == 3700.5 and str(line[0]["x"]) == "2025-01-01 00:00:00"
    raw = ts.chart_line(sales, "date", "revenue", "none")
    assert raw.count() == 20 and ts.chart_area(sales, "date", "revenue", "count").count() == 20
    wide = spark.range(1000).selectExpr("id % 40 AS k", "id AS v")
    assert ts.chart_bar(wide, "k", "v").count() == 15 and ts.chart_donut(wide, "k", "v").count() == 10
    assert ts.chart_donut(wide, "k", "v", "mean").first()["x"] == 39


def test_histogram(spark):
    df = spark.createDataFrame([(float(i % 31),) for i in range(310)] + [(None,)], "x double")
    found = rows(ts.chart_histogram(df, "x"), "bin")
    assert len(found) == 30 and sum(r["count"] for r in found) == 310
    assert found[-1]["count"] == 20 and found[0]["lower"] == 0.0 and found[-1]["upper"] == 30.0
    same = rows(ts.chart_histogram(spark.createDataFrame([(2.0,)] * 5, "x double"), "x"), "bin")
    assert [(r["bin"], r["count"]) for r in same] == [(0, 5)]
    assert ts.chart_histogram(spark.createDataFrame([(None,)], "x double"), "x").count() == 0


def test_scatter_is_exact_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id AS a", "IF(id % 10 = 0, NULL, id * 2) AS b")
    one = sorted(map(tuple, ts.chart_scatter(df, "a", "b").collect()))
    other = sorted(map(tuple, ts.chart_scatter(df.repartition(7), "a", "b").collect()))
    assert one == other and len(one) == 1000 and all(y == 2 * x for x, y in one)
    assert ts.chart_scatter(df.limit(50), "a", "b").count() == 45


def test_metric_comparison(spark):
    df = spark.range(100).selectExpr(
        "id AS row_number", "id % 10 AS qty", "id % 3 AS width", "rand(1) AS noise",
        "IF(id < 70, rand(2), NULL) AS sparse", "CAST(id % 7 AS DOUBLE) AS week",
    )
    found = [r["metric"] for r in ts.metric_comparison(df).collect()]
    assert found == ["qty", "week", "sparse"]  # width holds "id", the others are nearly unique
    sums = by_key(ts.metric_comparison(df, ["qty"], "sum"), "metric")
    assert sums["qty"]["value"] == 450.0
    assert ts.metric_comparison(df, ["width"]).count() == 0


def source_scans(spark, path, run):
    """(full scans, scans of leading rows or of footers only) of a file that executed queries made."""
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    full = few = 0
    found = store.executionsList()
    for i in range(known, found.size()):
        execution = found.apply(i)
        nodes = store.planGraph(execution.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Scan parquet" in node.name() and path in node.desc():
                partial = "ReadSchema: struct<>" in node.desc() or "take at" in execution.description()
                full, few = full + (not partial), few + partial
    return full, few


def test_parts_of_a_standard_run_share_their_scans(spark, tmp_path):
    """Nine full scans, whatever the number of parts; one look at leading rows, one at footers.

    Columns of fewer than 5,000 values are read once more for their normality test, tables of more than
    a million values once or twice more for quantiles.
    """
    path = str(tmp_path / "sales")
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int"))
    spark.range(6000).select(
        F.col("id").alias("order_id"), days.alias("day"),
        F.element_at(F.array(*[F.lit(x) for x in "abcd"]), (F.col("id") % 4 + 1).cast("int")).alias("region"),
        F.concat(F.lit("p"), F.col("id") % 9).alias("product"),
        *[(F.col("id") * (i + 3) % (97 + i) + F.when(F.col("id") % 500 == 0, 5000).otherwise(0.0)).alias(n)
          for i, n in enumerate(["revenue", "units", "cost", "discount", "weight", "score"])],
    ).coalesce(1).write.parquet(path)
    made = []
    full, few = source_scans(spark, path, lambda: made.append(ts.analyze(spark.read.parquet(path))))
    with made[0] as run:
        wanted = {"numeric_summary", "categorical_summary", "distributions", "trends", "segments", "correlations", "outlier_examples"}
        assert wanted <= set(run.tables) and run.skipped.where("status = 'failed'").count() == 0
        # What comes from shared scans is what each operator finds by itself.
        df = spark.read.parquet(path)
        for name, alone in (
            ("numeric_summary", ts.numeric_summary(df)), ("table_quality", ts.table_quality(df)), ("kpis", ts.kpis(df)),
            ("categorical_summary", ts.categorical_summary(df)), ("segments", ts.segments(df)), ("time_profile", ts.time_profile(df)),
            ("trends", ts.trends(df)), ("outlier_examples", ts.outlier_examples(df)), ("schema_profile", ts.schema_profile(df)),
        ):
            got, want = (sorted((shortened(r) for r in x.select(alone.columns).collect()), key=str) for x in (run[name], alone))
            assert got == want, name
    assert full <= 9 and few <= 2


def shortened(row):
    return [f"{v:.9g}" if isinstance(v, float) else str(v) for v in row]
