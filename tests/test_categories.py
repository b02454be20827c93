import pytest

import tallyscope as ts
from tests.conftest import by_key, rows


def test_golden(sales, sales10):
    found = by_key(ts.categorical_summary(sales10), "column")
    assert {c: (r["cardinality"], r["concentration"]) for c, r in found.items()} == {
        "region": (4, "moderate"), "product": (3, "moderate"), "date": (5, "dispersed"),
    }
    found = by_key(ts.categorical_summary(sales), "column")
    assert found["date"]["other_pct"] == 50.0 and found["date"]["cardinality"] == 10
    assert found["region"]["top_value"] == "North" and found["region"]["top_pct"] == 30.0


def test_ties_go_to_the_smaller_value_and_five_are_kept(spark):
    df = spark.createDataFrame([(v,) for v in "gfedcba" * 3], "s string")
    top = rows(ts.category_top_values(df), "rank")
    assert [r["value"] for r in top] == list("abcde")
    assert by_key(ts.categorical_summary(df), "column")["s"]["other_pct"] == pytest.approx(200 / 7)


def test_high_cardinality(spark):
    data = [(f"v{i}", f"w{i % 100}", "long " * 20 + str(i % 900), i % 2 == 0) for i in range(1000)]
    df = spark.createDataFrame(data, "a string, b string, c string, d boolean")
    found = by_key(ts.categorical_summary(df), "column")
    assert found["a"]["is_high_cardinality"] and found["a"]["cardinality"] == 1000
    assert found["a"]["other_pct"] == 100.0 and found["a"]["concentration"] == "dispersed"
    assert not found["b"]["is_high_cardinality"] and found["c"]["cardinality"] == 900
    assert found["d"]["cardinality"] == 2 and found["d"]["concentration"] == "moderate"
    assert {r["column"] for r in rows(ts.category_top_values(df), "rank")} == {"b", "d"}


def test_late_high_cardinality_is_not_missed(spark):
    """The leading rows show one value only."""
    df = spark.range(6000).selectExpr("IF(id < 5000, 'same', concat('v', id)) AS s").coalesce(1)
    found = by_key(ts.categorical_summary(df), "column")["s"]
    assert found["cardinality"] == 1001 and found["is_high_cardinality"]
    assert ts.infer_types(df) == {"s": "id"}


def test_concentration_is_strict(spark):
    half = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2, "s string")
    assert by_key(ts.categorical_summary(half), "column")["s"]["concentration"] == "moderate"
    more = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "s string")
    assert by_key(ts.categorical_summary(more), "column")["s"]["concentration"] == "high"


def test_empty_columns_and_tables_without_categories(spark):
    df = spark.createDataFrame([(None, 1)], "s string, n int")
    assert ts.categorical_summary(df).count() == 0
    assert ts.categorical_summary(df.select("n")).count() == 0
    assert ts.category_top_values(df.select("n")).count() == 0


def test_golden_kpis(sales10):
    found = [(r["name"], r["formatted_value"]) for r in rows(ts.kpis(sales10), "rank")]
    assert found == [
        ("Total Records", "10"),
        ("Date Range", "Jan 2025 – Jan 2025"),
        ("Time Span", "4 days"),
        ("Total Revenue", "$20.5K"),
        ("Avg Revenue", "$2.1K"),
        ("Total Units Sold", "410"),
        ("Total Discount Pct", "85"),
        ("Unique Regions", "4"),
        ("Unique Products", "3"),
    ]


def test_kpi_names_repeat_once_and_ten_are_kept(spark):
    names = ["total_a", "Total_A", *[f"cost_{i}" for i in range(8)]]
    schema = ", ".join(f"{n}_{i} double" for i, n in enumerate(names[:2])) + ", " + ", ".join(
        f"{n} double" for n in names[2:]
    )
    df = spark.createDataFrame([tuple(float(i + j) for j in range(10)) for i in range(5)], schema)
    found = rows(ts.kpis(df), "rank")
    assert len(found) == 10 and len({r["name"] for r in found}) == 10
    assert [r["confidence"] for r in found] == [1.0] + [0.85] * 9


def test_currency_rule(spark):
    df = spark.createDataFrame(
        [(1.5, -1.0, -2.0, 3.5), (2.5, 1.0, 2.0, 4.5), (2.5, 1.0, 3.0, 4.5)],
        "price double, sale_price double, amount double, cost double",
    )
    found = by_key(ts.kpis(df, limit=20), "name")
    assert found["Total Price"]["formatted_value"] == "$6.50"
    assert found["Total Sale Price"]["formatted_value"] == "1.00"  # has a negative value
    assert found["Total Amount"]["formatted_value"] == "$3.00"
    assert found["Total Cost"]["formatted_value"] == "12.50"


def test_number_format_matches_python(spark):
    from pyspark.sql import functions as F

    from tallyscope.functions import human_number

    values = [0.0, 0.125, 2.675, 999.994, 999.995, 1000.0, 1250.0, 1350.0, 405950.05, 405950.0,
              -1500.0, 1e6, 2.25e6, 123456789.0, 1e9, 7.35e12, -0.005]

    def expected(v):
        for limit, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
            if abs(v) >= limit:
                return f"{v / limit:.1f}{letter}"
        return f"{v:.2f}"

    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(human_number(F.col("v"))).collect()]
    assert got == [expected(v) for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(human_number(F.col("v"))).collect()] == ["N/A"] * 3
    assert df.limit(1).select(human_number(F.lit(42), True, True)).first()[0] == "$42"


def test_kpis_per_group(spark):
    data = [("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 5.0), ("b", "x", 6.0), (None, "y", 1.0)] * 3
    df = spark.createDataFrame(data, "g string, kind string, revenue double")
    found = by_key(ts.kpis(df, by=["g"]), "g", "name")
    assert found["a", "Total Revenue"]["value"] == 9.0
    assert found["a", "Unique Kinds"]["value"] == 2.0
    assert ("b", "Unique Kinds") not in found  # one value only
    assert found[None, "Total Records"]["value"] == 3.0
