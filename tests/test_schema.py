import datetime as dt

import pytest
from pyspark.sql import functions as F

import tallyscope as ts
from tallyscope.plans import table as plans_table
from tallyscope.plans.table import set_sizes
from tests.conftest import by_key, rows


def types_of(spark, data, schema):
    return ts.infer_types(spark.createDataFrame(data, schema))


def test_names_decide_ids(spark):
    names = "id, user_id, uuid, Index, api_key, o_orderkey, idx, valid"
    schema = ", ".join(f"`{n.strip()}` double" for n in names.split(","))
    types = types_of(spark, [tuple(i + 0.5 for _ in range(8)) for i in range(5)], schema)
    assert [c for c, t in types.items() if t == "id"] == ["id", "user_id", "uuid", "Index", "api_key"]


def test_booleans(spark):
    data = [
        (i % 2, float(i % 2), ["yes", "no"][i % 2], ["Y", "N"][i % 2], None, i % 3, i % 2 == 0, "Y")
        for i in range(12)
    ]
    schema = "a int, b double, c string, d string, e string, f int, g boolean, h string"
    types = types_of(spark, data, schema)
    assert types == {**dict.fromkeys("abcdegh", "boolean"), "f": "numeric"}


def test_mixed_boolean_words_are_not_boolean(spark):
    data = [(w,) for w in ["yes", "no", "Y"] * 4]
    assert types_of(spark, data, "a string") == {"a": "categorical"}


def test_integer_ids_need_many_distinct_values(spark):
    n = 200
    data = [(i % 100, i % 101, i * 7, float(i)) for i in range(n)]
    types = types_of(spark, data, "few int, enough int, all int, real double")
    assert types == {"few": "numeric", "enough": "id", "all": "id", "real": "numeric"}
    # 101 distinct values of 202 rows are not more than half
    data = [(i % 101,) for i in range(202)]
    assert types_of(spark, data, "half int") == {"half": "numeric"}


def test_sparse_integers_are_counted_exactly(spark):
    """The range would allow an id, the distinct count does not."""
    data = [((i % 50) * 1_000_000,) for i in range(400)]
    assert types_of(spark, data, "a bigint") == {"a": "numeric"}


def test_strings_by_cardinality_and_length(spark):
    data = [
        (f"v{i % 100}", f"v{i % 101}", f"{i % 101:051d}x", f"{i % 101:050d}", f"z{i}")
        for i in range(300)
    ]
    types = types_of(spark, data, "a string, b string, c string, d string, e string")
    assert types == {"a": "categorical", "b": "id", "c": "text", "d": "id", "e": "id"}


def test_distinct_share_of_small_tables(spark):
    data = [(["p", "q"][i % 2], f"x{i % 3}") for i in range(4)]
    types = types_of(spark, data, "half string, more string")
    assert types == {"half": "categorical", "more": "id"}


def test_date_strings_need_more_than_80_of_100(spark):
    def dates(good):
        start = dt.date(2024, 1, 1)
        return [str(start + dt.timedelta(i % 5)) if i < good else "none" for i in range(100)]

    data = list(zip(dates(81), dates(80), [f"{d[5:7]}/{d[8:]}/{d[:4]}" for d in dates(100)]))
    types = types_of(spark, data, "a string, b string, c string")
    assert types == {"a": "temporal", "b": "categorical", "c": "temporal"}


def test_one_date_format_per_column(spark):
    data = [("2024-01-05",), ("01/05/2024",), ("2024-01-07",)] * 10
    assert types_of(spark, data, "d string") == {"d": "categorical"}


def test_profile_and_samples(spark):
    data = [(None, "b", [1]), (2, "c", [1]), (1, "d", [1]), (5, None, [1]), (4, "a", [2])]
    df = spark.createDataFrame(data, "n int, s string, nested array<int>").coalesce(1)
    profile = by_key(ts.schema_profile(df), "column")
    assert list(profile) == ["n", "s"]  # nested columns are left out
    assert profile["n"]["sample_values"] == ["2", "1", "5"]
    assert profile["s"]["sample_values"] == ["b", "c", "d"]
    assert profile["n"]["row_count"] == 5 and profile["n"]["col_count"] == 2
    assert ts.Table(df).unsupported == ["nested"]


def test_samples_of_a_column_that_starts_empty(spark):
    df = spark.range(5000).selectExpr("IF(id >= 4990, id, NULL) AS late").coalesce(1)
    assert rows(ts.sample_values(df), "column")[0]["sample_values"] == ["4990", "4991", "4992"]


def test_type_summary_lists_all_types(sales):
    counts = by_key(ts.type_summary(sales), "inferred_type")
    assert {k: v["n_columns"] for k, v in counts.items()} == {
        "numeric": 3, "categorical": 2, "temporal": 1, "text": 0, "boolean": 0, "id": 0,
    }


def test_odd_column_names(spark):
    df = spark.createDataFrame([(i, "it's") for i in range(30)], "`a.b c` int, `quo'te``d` string")
    assert ts.infer_types(df) == {"a.b c": "numeric", "quo'te`d": "categorical"}
    assert rows(ts.numeric_summary(df), "column")[0]["column"] == "a.b c"
    top = rows(ts.category_top_values(df), "rank")[0]
    assert (top["column"], top["value"], top["count"]) == ("quo'te`d", "it's", 30)
    assert ts.analyze(df, "quick")["findings"].count() > 0


def test_texts_in_clusters_are_not_shuffled(spark, capfd):
    """The first 2,000 rows are all alike, so only the whole table shows how many texts there are."""
    texts = "IF(id < 20000, 'same text', concat('a long text of its own, more than thirty-two letters ', id))"
    df = spark.range(60_000, numPartitions=4).selectExpr(f"{texts} AS free", "concat('c', id div 3000) AS few")
    sizes = set_sizes(ts.Table(df), ["free", "few"], 10)
    assert sizes["few"] == 20 and 1024 < sizes["free"] < 80_000
    assert ts.infer_types(df) == {"free": "id", "few": "categorical"}
    hashed = [F.theta_sketch_agg(F.xxhash64(c), F.lit(10)) for c in df.columns]
    df.groupBy(F.spark_partition_id()).agg(*hashed).explain()
    exchange = [line for line in capfd.readouterr().out.splitlines() if "Exchange" in line]
    assert exchange and not any("free#" in line for line in exchange)


@pytest.mark.parametrize("distinct", [4_900, 5_000, 5_001, 5_100, 9_999])
def test_ids_around_half_the_rows(spark, distinct):
    """Numbers that a bounded set cannot tell from half the rows are counted."""
    df = spark.range(10_000, numPartitions=3).selectExpr(f"id % {distinct} * 7919 AS n")
    for bits in (14, 6):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(plans_table, "WIDE_SET_BITS", bits)
            assert ts.infer_types(df) == {"n": "id" if distinct > 5_000 else "numeric"}


def test_set_sizes_are_exact_until_full(spark):
    df = spark.range(50_000, numPartitions=7).selectExpr("id % 1000 AS a", "IF(id % 2 = 0, id % 300, NULL) AS b", "CAST(NULL AS INT) AS c", "id AS d")
    found = set_sizes(ts.Table(df), ["a", "b", "c", "d"], 10)
    assert (found["a"], found["b"], found["c"]) == (1000, 150, 0) and abs(found["d"] - 50_000) < 7 * 50_000 / 32
    assert set_sizes(ts.Table(df.limit(0)), ["a"], 10) == {"a": 0}
