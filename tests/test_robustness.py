"""What a second run, an infinity, several partitions or an odd file must not change."""

import os

import pytest
from pyspark.sql import functions as F

import tallyscope as ts
from tallyscope.operators import quality, schema
from tallyscope.plans import table as tables


def test_second_run_sees_the_new_file(spark, tmp_path):
    path = str(tmp_path / "t.parquet")

    def run(n):
        spark.range(n).select((F.col("id") * 1.0).alias("revenue")).write.mode("overwrite").parquet(path)
        with ts.analyze(spark.read.parquet(path), "quick") as found:
            return {r.name: r.value for r in found["kpis"].collect()}

    assert run(1000)["Total Records"] == 1000 and run(5000)["Total Records"] == 5000


def test_nothing_stays_cached_or_on_disk(spark):
    df = spark.range(100).select("id", (F.col("id") % 7 * 1.0).alias("price"))
    cached = set(spark._jsc.getPersistentRDDs())
    run = ts.analyze(df)
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in run.tables.values()]
    assert plans and not any("InMemoryTableScan" in p for p in plans)
    assert set(spark._jsc.getPersistentRDDs()) <= cached
    paths = list(run.table._paths)
    assert paths and all(os.path.isdir(p) for p in paths)
    run.close()
    assert not any(os.path.exists(p) for p in paths)


def test_a_part_that_fails_while_it_is_read_is_noted(spark, monkeypatch):
    def broken(t):
        return t.df.select(F.raise_error(F.lit("no such luck")).cast("string").alias("name"))

    monkeypatch.setattr(quality, "column_quality", broken)
    run = ts.analyze(spark.range(50).select((F.col("id") * 1.0).alias("revenue")), "quick")
    assert [(r.name, r.status) for r in run.skipped.collect()] == [("column_quality", "failed")]
    assert run["findings"].count() > 0
    run.close()


@pytest.mark.parametrize("n", [51, 5001])
def test_infinity_is_not_normal(spark, n):
    df = spark.range(n).select(F.when(F.col("id") == 0, float("inf")).otherwise(F.col("id") * 1.0).alias("x"))
    r = ts.distributions(df).first()
    assert (r.is_normal, r.normality_p_value) == (False, 0.0) and r.distribution_type == "skewed"


def test_histogram_counts_infinities_apart(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, float("inf"), float("-inf"), float("nan"))], "x double")
    got = {r.bin: (r.lower, r.upper, r["count"]) for r in ts.chart_histogram(df, "x", 2).collect()}
    inf = float("inf")
    assert got == {-1: (-inf, 0.0, 1), 0: (0.0, 1.0, 1), 1: (1.0, 2.0, 2), 2: (2.0, inf, 1)}


def test_row_index_is_a_position(spark):
    df = spark.range(0, 1000, 1, 4).select(F.when(F.col("id").isin(300, 999), 1e6).otherwise(F.col("id") % 10).alias("x"))
    assert sorted(r.row_index for r in ts.outlier_examples(df).collect()) == [300, 999]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_repeated_hashes_on_both_sides_of_the_broadcast(spark, limit):
    df = spark.range(600).select((F.col("id") % 500).alias("a"), F.lit("x").alias("b"))
    found = ts.duplicate_rows(df, broadcast_hashes=limit)
    assert found.first().duplicate_rows == 100
    assert "left_semi" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")


def test_long_texts_are_shuffled_as_digests(spark):
    df = spark.range(50).select(F.concat(F.lit("long " * 20), F.col("id") % 3).alias("t"))
    t = ts.Table(df)
    assert tables.exact_distinct(t, ["t"]) == {"t": 3}


def test_the_format_that_reads_most_values(spark):
    rows = [("01/02/2024",)] + [(f"2024-03-{d:02d}",) for d in range(1, 20)]
    t = ts.Table(spark.createDataFrame(rows, "d string"))
    assert t.date_formats["d"] == "yyyy-MM-dd" and schema.temporal_strings(t, ["d"]) == {"d"}


def test_one_date_does_not_make_an_axis_of_dates(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("b", 2), ("c", 3), ("d", 4)], "x string, y int")
    assert [r.x for r in ts.chart_line(df, "x", "y").collect()] == ["2024-01-01", "b", "c", "d"]


def test_local_times_that_the_zone_skips(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-03-09 02:30:00",), ("1969-12-31 23:59:59",)], "d string")
        t = ts.Table(df)
        assert [str(r.m) for r in t.df.select(t.moment("d").alias("m")).collect()] == [
            "2025-03-09 02:30:00", "1969-12-31 23:59:59"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_files_with_another_header_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x\n3,4\n")
    with pytest.raises(ts.InputError, match="another header"):
        ts.read_csv(spark, str(tmp_path))


def test_a_replacement_character_is_valid_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\né,�\n", encoding="utf-8")
    found = ts.read_csv(spark, str(tmp_path))
    assert found.encoding == "UTF-8" and found.df.first().x == "é"


def test_only_open_quotes_keep_a_file_in_one_piece(spark, tmp_path):
    from tallyscope.sources import csv

    (tmp_path / "a.csv").write_text('x,y\n1,"a, b"\n')
    assert not csv._has_open_quotes(spark, str(tmp_path), "*.csv")
    (tmp_path / "a.csv").write_text('x,y\n1,"a\nb"\n')
    assert csv._has_open_quotes(spark, str(tmp_path), "*.csv")
    assert ts.read_csv(spark, str(tmp_path)).df.first().y == "a\nb"


def test_limits_are_arguments_and_what_they_leave_out_is_noted(spark):
    days = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 40).cast("int"))
    df = spark.range(200).select(
        days.alias("day"), *[(F.col("id") % (5 + i) * 1.0).alias(f"price_{i}") for i in range(7)]
    )
    with ts.analyze(df) as run:
        left = {r["name"]: r.reason for r in run.skipped.where("status = 'limited'").collect()}
        assert left == {"trends": "trends: left out price_5, price_6"}
        assert run["trends"].count() == 5 and run["findings"].count() <= 15
    everything = ts.Limits(kpis=None, trend_metrics=None, segments=None, findings=None)
    with ts.analyze(df, limits=everything) as run:
        assert run.skipped.where("status = 'limited'").count() == 0
        assert run["trends"].count() == 7


@pytest.mark.parametrize("by", [[], ["g"]])
def test_many_passes_find_the_same_quantiles_as_one(spark, by):
    from tallyscope.plans import quantiles as q

    df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * F.col("id") % 1009 * 1.0).alias("x"))
    t = ts.Table(df, by)
    got = sorted(map(str, q.quantiles(t, ["x"], [0.05, 0.5, 0.95], listed_values=0).collect()))
    wanted = sorted(map(str, q.quantiles(t, ["x"], [0.05, 0.5, 0.95]).collect()))
    assert got == wanted and len(got) == len(by) + 1
