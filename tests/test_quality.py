import pytest

import tallyscope as ts
from tests.conftest import by_key, rows

NAN = float("nan")


def test_nan_is_missing_infinity_is_not(spark):
    df = spark.createDataFrame(
        [(1.0, "a"), (NAN, "b"), (None, None), (float("inf"), "d")], "x double, s string"
    )
    found = by_key(ts.column_quality(df), "column")
    assert found["x"]["missing_count"] == 2 and found["x"]["missing_pct"] == 50.0
    assert found["s"]["missing_count"] == 1 and found["s"]["is_flagged"]


def test_flag_is_strict_at_five_percent(spark):
    df = spark.createDataFrame(
        [(None if i < 5 else i, None if i < 6 else i) for i in range(100)], "a int, b int"
    )
    found = by_key(ts.column_quality(df), "column")
    assert not found["a"]["is_flagged"] and found["b"]["is_flagged"]


def test_duplicates_with_nulls_and_signed_zero(spark):
    data = [(1, None, 0.0), (1, None, -0.0), (1, None, 0.0), (2, "a", NAN), (2, "a", NAN), (3, "b", 1.0)]
    df = spark.createDataFrame(data, "k int, s string, x double")
    assert ts.duplicate_rows(df).first()["duplicate_rows"] == 3
    per_key = by_key(ts.duplicate_rows(df, ["k"]), "k")
    assert {k: v["duplicate_rows"] for k, v in per_key.items()} == {1: 2, 2: 1, 3: 0}


def test_many_duplicates_without_broadcast(spark, monkeypatch):
    from tallyscope.operators import quality

    monkeypatch.setattr(quality, "BROADCAST_HASHES", 0)
    df = spark.range(1000).selectExpr("id % 300 AS a", "id % 2 AS b")
    expected = 1000 - df.distinct().count()
    assert ts.duplicate_rows(df).first()["duplicate_rows"] == expected


def test_constants(spark):
    df = spark.createDataFrame(
        [(1, None, "x", 1.0), (1, None, None, 2.0), (1, None, "x", 1.0)],
        "a int, b string, c string, d double",
    )
    assert [r["column"] for r in rows(ts.constant_columns(df), "position")] == ["a", "b", "c"]


def test_score_and_warnings(spark):
    data = [(1, "x", None if i % 2 else i) for i in range(10)]
    df = spark.createDataFrame(data, "a int, b string, c int")
    found = ts.table_quality(df).first()
    missing, complete, copies = 5 / 30, 0.5, 4
    score = 0.35 * (1 - missing) + 0.35 * complete + 0.15 * max(0, 1 - copies) + 0.15 * (1 - 2 / 3)
    assert found["overall_score"] == pytest.approx(score)
    assert found["duplicate_rows"] == 4 and found["constant_columns"] == 2
    assert found["warnings"] == [
        "High missing values (>5%) in: c",
        "Only 50.0% of rows are complete (no missing values)",
        "4 duplicate rows detected (40.0%)",
        "Constant columns (no analytical value): a, b",
    ]


def test_long_name_lists_are_cut(spark):
    schema = ", ".join(f"c{i} int" for i in range(7))
    df = spark.createDataFrame([tuple([None] * 7), tuple(range(7)), tuple(range(1, 8))], schema)
    first = ts.table_quality(df).first()["warnings"][0]
    assert first == "High missing values (>5%) in: c0, c1, c2, c3, c4 and 2 more"


def test_empty_table(spark):
    found = ts.table_quality(spark.createDataFrame([], "a int, b string")).first()
    assert found["overall_score"] == 0.0 and found["warnings"] == ["DataFrame is empty"]
    assert ts.column_quality(spark.createDataFrame([], "a int")).count() == 0


def test_per_group_with_a_null_key(spark):
    df = spark.createDataFrame([("u", 1), ("u", None), (None, 3), (None, 3)], "g string, x int")
    found = by_key(ts.table_quality(df, ["g"]), "g")
    assert found["u"]["total_missing_cells"] == 1 and found["u"]["complete_rows_pct"] == 50.0
    assert found[None]["duplicate_rows"] == 1


def test_sample_is_perfect(sales):
    assert ts.table_quality(sales).first()["overall_score"] == pytest.approx(1.0)


def test_rows_read_alike_only_if_all_values_are(spark):
    rows_ = [("1:a", None, 1.0), ("1", ":a", 1.0), ("", None, 0.0), (None, "", -0.0), ("-", None, None), (None, "-", None)]
    rows_ += [("12:b", "-", 5.0), ("1", "2:b-", 5.0), ("", None, -0.0), (None, "-", None)]
    df = spark.createDataFrame(rows_, "a string, b string, n double")
    assert ts.duplicate_rows(df).first()["duplicate_rows"] == 2


def test_a_table_of_copies_shuffles_digests_only(spark):
    long = "concat('some long text of a row ', id % 500, repeat('x', 200))"
    df = spark.range(50_000, numPartitions=6).selectExpr(f"{long} AS text", "id % 5 AS n")
    found = ts.duplicate_rows(df)
    assert found.first()["duplicate_rows"] == 49_500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("text#" in line for line in plan.splitlines() if "Exchange" in line)
