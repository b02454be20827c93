import math

import numpy as np
import pytest

import tallyscope as ts
from tests.conftest import by_key, rows


def test_golden_segments(sales, sales10):
    found = by_key(ts.segments(sales10), "segment_column", "kpi_column", "value")
    sums = {v: found["region", "revenue", v]["kpi_value"] for v in ("North", "South", "East", "West")}
    assert sums == {"North": 7450, "South": 5400.5, "East": 4750, "West": 2900}
    assert found["region", "revenue", "North"]["kpi_contribution_pct"] == pytest.approx(36.34, abs=5e-3)
    assert found["date", "revenue", "2025-01-04"]["rank"] == 1
    insights = by_key(ts.segment_insights(sales10), "segment_column", "kpi_column")
    assert insights["region", "revenue"]["concentration_index"] == pytest.approx(0.275157, abs=5e-7)
    assert insights["product", "revenue"]["concentration_index"] == pytest.approx(0.336775, abs=5e-7)
    assert insights["date", "revenue"]["concentration_index"] == pytest.approx(0.202105, abs=5e-7)
    larger = by_key(ts.segment_insights(sales), "segment_column", "kpi_column")
    assert larger["region", "revenue"]["concentration_index"] == pytest.approx(0.253457, abs=5e-7)
    assert larger["product", "revenue"]["top_value"] == "Widget C"


def test_shares_add_up_and_ten_are_kept(spark):
    data = [(f"s{i % 14:02d}", "only", float(i % 14 + 1)) for i in range(140)]
    df = spark.createDataFrame(data, "a string, b string, revenue double")
    found = rows(ts.segments(df), "rank")
    assert len(found) == 10 and {r["segment_column"] for r in found} == {"a"}
    every = ts.Table(df)
    from tallyscope.operators.segments import all_segments

    total = sum(r["kpi_contribution_pct"] for r in all_segments(every).collect())
    assert total == pytest.approx(100)


def test_segment_ties_nulls_and_zero_bottom(spark):
    data = [("b", 5.0), ("a", 5.0), ("c", None), (None, 7.0), ("c", None)]
    df = spark.createDataFrame(data * 2, "s string, value double")
    found = rows(ts.segments(df), "rank")
    assert [(r["value"], r["kpi_value"], r["count"]) for r in found] == [("a", 10.0, 2), ("b", 10.0, 2), ("c", 0.0, 0)]
    assert ts.segment_insights(df).first()["performance_spread"] is None


def test_segment_limits(spark):
    data = [(f"x{i % 20}", f"y{i % 21}", "one", float(i)) for i in range(420)]
    df = spark.createDataFrame(data, "a string, b string, c string, plain double")
    found = ts.segments(df)
    assert {r["segment_column"] for r in found.collect()} == {"a"}
    assert {r["kpi_column"] for r in found.collect()} == {"plain"}  # first numeric
    zero = spark.createDataFrame([("a", 1.0), ("b", -1.0)] * 5, "s string, value double")
    assert ts.segments(zero).count() == 0


def frame(spark, columns, parts=3):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns)).repartition(parts)


def test_correlation_against_numpy(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 500)
    b = a + rng.normal(0, 1, 500)
    c = np.where(rng.random(500) < 0.4, np.nan, -a + rng.normal(0, 0.2, 500))
    d = np.where(rng.random(500) < 0.4, np.nan, rng.normal(1e6, 1, 500))
    found = by_key(ts.correlations(frame(spark, {"a": a, "b": b, "c": c, "d": d})), "column_a", "column_b")
    values = {"a": a, "b": b, "c": c, "d": d}
    assert len(found) == 6
    for (x, y), r in found.items():
        both = ~np.isnan(values[x]) & ~np.isnan(values[y])
        assert r["n"] == both.sum()
        assert r["r"] == pytest.approx(np.corrcoef(values[x][both], values[y][both])[0, 1], abs=1e-9)
    assert found["a", "c"]["strength"] == "strong_negative" and found["a", "c"]["is_collinear"]
    assert found["a", "b"]["is_significant"] and not found["a", "d"]["is_significant"]


def test_exact_constant_and_disjoint_pairs(spark):
    n = 40
    x = np.arange(n, dtype=float)
    columns = {
        "x": x,
        "double": 2 * x,
        "minus": -x,
        "same": np.ones(n),
        "first": np.where(x < 20, x, np.nan),
        "last": np.where(x >= 20, x, np.nan),
        "flat_where_first": np.where(x < 20, 7.0, x),
    }
    found = by_key(ts.correlations(frame(spark, columns)), "column_a", "column_b")
    assert found["x", "double"]["r"] == pytest.approx(1.0) and found["x", "double"]["p_value"] < 1e-12
    assert found["x", "minus"]["r"] == pytest.approx(-1.0)
    assert not any("same" in pair for pair in found)
    assert ("first", "last") not in found and ("first", "flat_where_first") not in found


def test_thirty_rows_are_needed(spark):
    x = np.arange(29, dtype=float)
    assert ts.correlations(frame(spark, {"a": x, "b": x * x})).count() == 0
    assert ts.correlations(frame(spark, {"a": x})).count() == 0


def test_significant_pairs_are_sorted_and_capped(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, 200)
    columns = {f"c{i}": base + rng.normal(0, 0.2 + i / 4, 200) for i in range(5)}
    found = [r.asDict() for r in ts.significant_pairs(frame(spark, columns)).collect()]
    sizes = [abs(r["r"]) for r in found]
    assert sizes == sorted(sizes, reverse=True) and len(found) > 5
    assert ts.top_correlations(frame(spark, columns)).count() == 5
    assert found[0]["interpretation"] == f"{found[0]['column_a']} and {found[0]['column_b']} show strong positive correlation"


def test_sixteenth_column_is_left_out(spark):
    columns = {f"c{i:02d}": np.sin(np.arange(50) * (i + 1)) for i in range(16)}
    found = ts.correlations(frame(spark, columns))
    assert found.count() == 105 and found.where("column_b = 'c15'").count() == 0
    assert ts.correlations(frame(spark, columns), max_columns=None).count() == 120


def test_correlation_per_group_with_a_constant_group(spark):
    data = [("u", float(i), float(i * i)) for i in range(40)] + [("c", float(i), 3.0) for i in range(40)]
    data += [("few", float(i), float(i)) for i in range(29)]
    found = by_key(ts.correlations(spark.createDataFrame(data, "g string, x double, y double"), by=["g"]), "g")
    assert set(found) == {"u"} and found["u"]["n"] == 40


def scans(df):
    """How often the plan reads a table."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("width", [15, 100])
def test_all_pairs_come_from_one_scan(spark, tmp_path, width):
    """Columns with nulls, infinities and far from zero, with and without groups."""
    rng = np.random.default_rng(width)
    base = rng.normal(0, 1, 3000)
    values = {}
    for i in range(width):
        v = 10.0 ** (i % 9) * (base * (i % 4) + rng.normal(5, 1, 3000))
        values[f"c{i}"] = np.where(rng.random(3000) < 0.1 * (i % 3), np.nan, v)
    values["c1"][7] = np.inf
    groups = np.where(rng.random(3000) < 0.7, "hot", rng.choice(["a", "b", None], 3000))
    path = str(tmp_path / "t")
    frame(spark, {"g": groups, **values}).write.parquet(path)
    df = spark.read.parquet(path)

    def wanted(rows):
        x = np.column_stack([v[rows] for v in values.values()])
        for i in range(width):
            for j in range(i + 1, width):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                if np.isfinite(x[both][:, [i, j]]).all():
                    yield f"c{i}", f"c{j}", both.sum(), np.corrcoef(x[both, i], x[both, j])[0, 1]

    one = ts.correlations(df.drop("g"), max_columns=None)
    found = by_key(one, "column_a", "column_b")
    assert scans(one) == 1
    every = {(a, b): (n, r) for a, b, n, r in wanted(np.ones(3000, bool))}
    assert set(found) == set(every)
    for pair, (n, r) in every.items():
        assert found[pair]["n"] == n and found[pair]["r"] == pytest.approx(r, abs=1e-10)
    if width == 15:
        grouped = ts.correlations(df, by=["g"])
        found = by_key(grouped, "g", "column_a", "column_b")
        assert scans(grouped) == 1
        every = {(g, a, b): (n, r) for g in ("hot", "a", "b", None) for a, b, n, r in wanted(groups == g)}
        assert set(found) == set(every)
        for key, (n, r) in every.items():
            assert found[key]["n"] == n and found[key]["r"] == pytest.approx(r, abs=1e-10)


def outlier_frame(spark):
    base = [float(i % 10 + 10) for i in range(40)]
    low, high = base + [-50.0, -60.0, -70.0], base + [90.0, 80.0, 15.0]
    both = base + [-40.0, 99.0, 98.0]
    on_fence = base + [12.0, 12.0, 12.0]
    data = [(i, *v) for i, v in enumerate(zip(low, high, both, on_fence))]
    return spark.createDataFrame(data, "rid int, low double, high double, both double, none double").coalesce(1)


def test_outliers(spark):
    df = outlier_frame(spark)
    found = by_key(ts.column_outliers(df), "column")
    assert {c: (r["low_count"], r["high_count"], r["direction"]) for c, r in found.items()} == {
        "low": (3, 0, "low"), "high": (0, 2, "high"), "both": (1, 2, "both"),
    }
    assert ts.outlier_summary(df).first()["total_outliers"] == 8
    assert ts.outlier_summary(df).first()["outlier_pct"] == pytest.approx(800 / (43 * 5))
    ex = by_key(ts.outlier_examples(df, row_id="rid"), "column", "side", "rank")
    assert [ex["low", "low", k]["value"] for k in (1, 2)] == [-70.0, -60.0]
    assert [ex["both", "high", k]["row_index"] for k in (1, 2)] == [41, 42]
    numbered = by_key(ts.outlier_examples(df), "column", "side", "rank")
    assert numbered["low", "low", 1]["row_index"] == 42


def test_values_on_a_fence_are_inside(spark):
    data = [(0.0,)] * 10 + [(1.0,)] * 10 + [(2.0,)] * 10 + [(3.5,), (-1.5,)]
    df = spark.createDataFrame(data, "x double")
    bounds = ts.fences(df).first()
    assert ts.column_outliers(df).count() == (0 if bounds["upper_bound"] >= 3.5 else 1)
    edge = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3] * 10 + [5]], "x double")
    b = ts.fences(edge).first()
    assert b["upper_bound"] == 3 + 1.5 * (3 - 1) - 0 or b["upper_bound"] >= 5
    assert ts.column_outliers(edge).count() == 0


def test_nothing_to_test(spark, sales):
    assert ts.column_outliers(sales).count() == 0
    assert ts.outlier_examples(sales).count() == 0
    assert ts.outlier_summary(sales).first()["total_outliers"] == 0
    assert ts.column_outliers(sales.select("region")).count() == 0


def test_suspicious(spark):
    n = 40
    data = [
        (i, 0.0 if i < 3 else float(i), float(i - 5), float(i - 5), 0.0 if i < 20 else 1.0 * i, 1.0 * i)
        for i in range(n)
    ]
    df = spark.createDataFrame(
        data, "rid int, item_count double, price double, price_change double, cost double, other double"
    ).coalesce(1)
    found = by_key(ts.suspicious_values(df), "column", "issue")
    assert found["item_count", "unexpected_zeros"]["count"] == 3
    assert found["price", "unexpected_negatives"]["count"] == 5
    assert found["price", "unexpected_negatives"]["examples"] == [-5.0, -4.0, -3.0]
    assert ("price_change", "unexpected_negatives") not in found
    assert ("cost", "unexpected_zeros") not in found  # half of the values
    assert {c for c, _ in found} == {"item_count", "price", "price_change"}


def test_outliers_per_group(spark):
    data = [("a", float(i % 7)) for i in range(60)] + [("a", 100.0)]
    data += [("b", float(i % 7 + 95)) for i in range(60)] + [("b", 0.0)] + [("c", 5.0)] * 20
    df = spark.createDataFrame(data, "g string, x double")
    found = by_key(ts.column_outliers(df, ["g"]), "g")
    assert found["a"]["direction"] == "high" and found["b"]["direction"] == "low" and "c" not in found
    again = by_key(ts.column_outliers(df, ["g"], listed_values=0), "g")
    assert again == found
    assert {r["value"] for r in ts.outlier_examples(df, ["g"]).collect()} == {100.0, 0.0}
    assert by_key(ts.outlier_summary(df, ["g"]), "g")["a"]["outlier_pct"] == pytest.approx(100 / 61)


def test_z_scores(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(100)] + [(50.0,)], "x double")
    assert ts.z_score_outliers(df).first()["z_count"] == 1
    assert not math.isnan(ts.z_score_outliers(df).first()["n"])
