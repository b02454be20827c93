import datetime as dt

import pytest
from pyspark.sql import functions as F

import tallyscope as ts
from tests.conftest import by_key, rows


def dated(spark, days, values=None):
    start = dt.datetime(2020, 1, 1)
    values = values or [1.0] * len(days)
    data = [(start + dt.timedelta(days=d), float(v)) for d, v in zip(days, values)]
    return spark.createDataFrame(data, "t timestamp_ntz, v double").repartition(3)


@pytest.mark.parametrize(
    "days, grain",
    [
        ([0, 1, 2, 3], "daily"),
        ([0, 1.5, 3], "daily"),
        ([0, 1.51, 3.02], "weekly"),
        ([0, 7, 14], "weekly"),
        ([0, 8, 16.1], "weekly"),  # median 8.05 of 8 and 8.1 is monthly, see below
        ([0, 30, 61, 91], "monthly"),
        ([0, 35, 70], "monthly"),
        ([0, 91, 182, 273], "quarterly"),
        ([0, 365, 730], "yearly"),
        ([0, 0, 0, 365], "daily"),
        ([0, 0, 30, 60, 90], "monthly"),
        ([0, 1, 100], "quarterly"),
    ],
)
def test_grain(spark, days, grain):
    if days == [0, 8, 16.1]:
        grain = "monthly"
    assert ts.time_grain(dated(spark, days)).first()["grain"] == grain


def test_grain_of_a_single_date_is_unknown(spark):
    assert ts.time_grain(dated(spark, [3])).count() == 0


def test_grain_matches_the_median_on_random_dates(spark):
    """The shortcut for crowded groups agrees with sorting everything."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    data, want = [], {}
    for g in range(60):
        n = int(rng.integers(2, 40))
        days = np.sort(rng.integers(0, int(rng.integers(1, 3000)), n))
        median = float(np.median(np.diff(days)))
        limits = [(1.5, "daily"), (8, "weekly"), (35, "monthly"), (100, "quarterly"), (1e9, "yearly")]
        want[g] = next(name for limit, name in limits if median <= limit)
        data += [(g, dt.date(2000, 1, 1) + dt.timedelta(days=int(d)), 1) for d in days]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["g", "t", "v"])).repartition(4)
    got = by_key(ts.time_grain(df, by=["g"]), "g")
    assert {g: r["grain"] for g, r in got.items()} == want


def series(spark, data, grain, **options):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(t), v) for t, v in data], "t timestamp_ntz, v double")
    return [(str(r["period"]), r["value"]) for r in rows(ts.period_series(df, "t", ["v"], grain, **options), "x")]


def test_periods_are_labelled_by_their_end_and_filled(spark):
    weeks = series(
        spark,
        [("2024-03-03T23:59:00", 1.0), ("2024-03-04T00:00:00", 2.0), ("2024-03-24T10:00:00", 4.0)],
        "weekly",
    )
    assert weeks == [("2024-03-03", 1.0), ("2024-03-10", 2.0), ("2024-03-17", 0.0), ("2024-03-24", 4.0)]
    ends = [("2024-01-31T12:00:00", 1.0), ("2024-02-29T12:00:00", 2.0), ("2024-07-01T00:00:00", 3.0)]
    assert series(spark, ends, "monthly") == [
        ("2024-01-31", 1.0), ("2024-02-29", 2.0), ("2024-03-31", 0.0), ("2024-04-30", 0.0),
        ("2024-05-31", 0.0), ("2024-06-30", 0.0), ("2024-07-31", 3.0),
    ]
    assert series(spark, ends, "quarterly") == [
        ("2024-03-31", 3.0), ("2024-06-30", 0.0), ("2024-09-30", 3.0),
    ]
    assert series(spark, ends, "yearly") == [("2024-12-31", 6.0)]
    days = [("2024-02-28T12:00:00", 1.0), ("2024-03-01T01:00:00", None), ("2024-03-02T00:00:00", 5.0)]
    assert series(spark, days, "daily") == [
        ("2024-02-28", 1.0), ("2024-02-29", 0.0), ("2024-03-01", 0.0), ("2024-03-02", 5.0),
    ]


GOLDEN = {
    10: {
        "revenue": (-30.1, -0.73, 0.871365, "stable", 3500.0, 4550.0, -23.08),
        "units_sold": (-0.6, -0.73, 0.871819, "stable", 70.0, 91.0, -23.08),
        "discount_pct": (-0.5, -2.94, 0.637618, "stable", 15.0, 15.0, 0.0),
    },
    20: {
        "revenue": (-57.9061, -1.38, 0.683936, "stable", 1850.0, 5700.0, -67.54),
        "units_sold": (-1.1576, -1.38, 0.684084, "stable", 37.0, 114.0, -67.54),
        "discount_pct": (2.5818, 11.13, 0.045934, "increasing", 55.0, 22.0, 150.0),
    },
}


@pytest.mark.parametrize("size", [10, 20])
def test_golden_trends(sales, sales10, size):
    for metric, r in by_key(ts.trends(sales if size == 20 else sales10), "metric").items():
        slope, pct, p, direction, current, previous, change = GOLDEN[size][metric]
        assert r["slope"] == pytest.approx(slope, abs=5e-5)
        assert r["slope_pct"] == pytest.approx(pct, abs=5e-3)
        assert r["p_value"] == pytest.approx(p, abs=1e-6) and r["direction"] == direction
        assert (r["current_value"], r["previous_value"]) == (current, previous)
        assert r["change_pct"] == pytest.approx(change, abs=5e-3)


def trend(spark, values):
    return ts.trends(dated(spark, range(len(values)), values)).first()


def test_trend_edges(spark):
    flat = trend(spark, [3, 3, 3, 3])
    assert (flat["slope"], flat["p_value"], flat["direction"]) == (0.0, 1.0, "stable")
    perfect = trend(spark, [1, 2, 3, 4])
    assert perfect["slope"] == pytest.approx(1.0, rel=1e-12) and perfect["p_value"] < 1e-6 and perfect["direction"] == "increasing"
    two = trend(spark, [1, 5])
    assert (two["slope"], two["p_value"], two["change_pct"]) == (0.0, 1.0, 400.0)
    zero = trend(spark, [-1, 1, -1, 1, 0])
    assert zero["slope_pct"] == 0.0 and zero["current_period"] == "2020-01-05"
    assert trend(spark, [2, 1, 0, 4])["change_pct"] == 0.0  # previous value 0


def test_date_column_choice(spark):
    df = spark.createDataFrame(
        [(i, f"2024-01-{i + 1:02d}" if i < 8 else None, dt.date(2024, 2, i + 1)) for i in range(10)],
        "number int, text string, day date",
    )
    assert ts.date_column(df) == "day"  # 80 % of the texts are not enough
    assert ts.date_column(df.limit(8)) == "text"
    assert ts.date_column(df.select("number")) is None
    assert ts.time_profile(df.select("number")) is None
    # an id by its name can still be the date column
    assert ts.date_column(df.withColumnRenamed("day", "date_key")) == "date_key"


def test_season(spark):
    data = [
        (dt.date(2022 + m // 12, m % 12 + 1, d), 20.0 if m % 12 == 11 else 10.0)
        for m in range(24)
        for d in (1, 15)
    ]
    df = spark.createDataFrame(data, "day date, sales double")
    found = ts.time_profile(df).first()
    assert found["seasonality_detected"] and found["pattern"] == "Dec typically highest"
    mean, sd = 130 / 12, (10.0**2 * (1 / 12) * (11 / 12) * 12 / 11) ** 0.5
    assert found["cv"] == pytest.approx(sd / mean * 100)
    assert (str(found["start"]), str(found["end"]), found["span_days"]) == ("2022-01-01", "2023-12-15", 713)
    calm = ts.time_profile(df.withColumn("sales", F.lit(3.0))).first()
    assert not calm["seasonality_detected"] and calm["cv"] == 0.0 and calm["pattern"] is None


def test_each_group_has_its_own_grain(spark):
    data = [("d", dt.date(2024, 1, 1 + i), 1.0) for i in range(20)]
    data += [("m", dt.date(2023, 1 + i, 5), 2.0) for i in range(6)]
    data += [(None, dt.date(2010 + i, 3, 3), 3.0) for i in range(5)]
    df = spark.createDataFrame(data, "g string, day date, v double")
    found = by_key(ts.trends(df, by=["g"]), "g")
    assert {g: r["periods"] for g, r in found.items()} == {"d": 20, "m": 6, None: 5}
    assert found["m"]["current_period"] == "2023-06-30" and found[None]["current_period"] == "2014-12-31"


def test_sample_is_daily_without_season(sales):
    found = ts.time_profile(sales).first()
    assert (found["date_column"], found["detected_grain"], found["span_days"]) == ("date", "daily", 9)
    assert not found["seasonality_detected"]


def brute_grain(moments):
    """From the sorted moments (in days)."""
    import numpy as np

    median = float(np.median(np.diff(np.sort(moments))))
    limits = [(1.5, "daily"), (8, "weekly"), (35, "monthly"), (100, "quarterly"), (1e9, "yearly")]
    return next(name for limit, name in limits if median <= limit)


def test_grain_of_ranges_that_cut_through_groups(spark):
    """Medians on, and between, the limits of two grains; groups over many ranges."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(8)
    data, want = [], {}
    for g in range(300):
        steps = rng.choice([0, 0.5, 1.5, 1.75, 8, 8.25, 35, 35.5, 100, 101, 400], int(rng.integers(1, 60)), p=rng.dirichlet(np.ones(11)))
        days = np.concatenate([[0.0], np.cumsum(steps)])
        want[g] = brute_grain(days)
        data += [(g, dt.datetime(2000, 1, 1) + dt.timedelta(days=float(d)), 1) for d in days]
    df = spark.createDataFrame(pd.DataFrame(data, columns=["g", "t", "v"])).repartition(7)
    got = by_key(ts.time_grain(df, by=["g"]), "g")
    assert {g: r["grain"] for g, r in got.items()} == want and len(set(want.values())) == 5
    for g in range(0, 300, 60):
        assert ts.time_grain(df.where(F.col("g") == g).drop("g")).first()["grain"] == want[g]


def test_a_date_far_off_neither_sorts_in_one_task_nor_makes_a_calendar(spark):
    df = spark.range(2_000_000).select(
        F.timestamp_seconds(F.col("id") * 400 + 946684800).cast("timestamp_ntz").alias("t"), (F.col("id") % 7).cast("double").alias("v")
    )
    df = df.unionAll(spark.sql("SELECT timestamp_ntz'9999-12-31 00:00:00' AS t, 3.0D AS v"))
    assert ts.time_grain(df).first()["grain"] == "daily"
    found = ts.trends(df).first()
    days = 8000 * 365
    assert found["periods"] > days and (found["current_value"], found["previous_value"]) == (3.0, 0.0)
    assert (found["current_period"], found["previous_period"]) == ("9999-12-31", "9999-12-30")
    plan = ts.trends(df)._jdf.queryExecution().toString()
    assert "explode" not in plan


def test_trends_count_empty_periods_as_zero(spark):
    """The closed form against least squares over the filled series, for every grain."""
    import numpy as np

    rng = np.random.default_rng(9)
    days = np.sort(rng.choice(3000, 40, replace=False))
    values = rng.normal(50, 20, 40) + days / 100
    df = dated(spark, [float(d) for d in days], values.tolist())
    for grain in ("daily", "weekly", "monthly", "quarterly", "yearly"):
        filled = rows(ts.period_series(df, "t", ["v"], grain), "x")
        y = np.array([r["value"] for r in filled])
        found = ts.trends(df, date_col="t", metrics=["v"], grain=grain).first()
        assert found["periods"] == len(y)
        assert found["slope"] == pytest.approx(np.polyfit(np.arange(len(y)), y, 1)[0], rel=1e-9)
        assert found["slope_pct"] == pytest.approx(found["slope"] / y.mean() * 100, rel=1e-9)
        r = np.corrcoef(np.arange(len(y)), y)[0, 1]
        t_value = r * np.sqrt((len(y) - 2) / (1 - r * r))
        assert found["p_value"] == pytest.approx(two_sided(abs(t_value), len(y) - 2), rel=1e-5)
        assert (found["current_value"], found["previous_value"]) == (pytest.approx(y[-1]), pytest.approx(y[-2]))
        assert (found["current_period"], found["previous_period"]) == tuple(str(r["period"]) for r in (filled[-1], filled[-2]))


def two_sided(t, df):
    """Student's tail by quadrature of the density."""
    import math

    import numpy as np

    angle = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, 200_001)
    density = np.cos(angle) ** (df - 1)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * scale * float(np.sum((density[1:] + density[:-1]) / 2) * (angle[1] - angle[0]))


def grouped(spark, groups):
    """(g, t, v): the days of each group, one row per day listed."""
    start = dt.datetime(2020, 1, 1)
    data = [(g, start + dt.timedelta(days=d), 1.0 + i) for g, days in groups.items() for i, d in enumerate(days)]
    return spark.createDataFrame(data, "g string, t timestamp_ntz, v double").repartition(3)


def test_values_of_many_groups_are_never_broadcast(spark, monkeypatch):
    """A table of group values beyond the limit, repeated for each salt, looks small to Spark by its files."""
    from tallyscope.plans import table as tables

    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    groups = {"a": [0, 7, 14], None: [0, 30, 60, 90], "busy": [0, 1] * 9}
    df = grouped(spark, groups)
    limits = spark.createDataFrame([(g, [float(len(d))]) for g, d in groups.items()], "g string, n array<double>")
    found = tables.with_group_values(ts.Table(df, ["g"]), df, limits)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r["g"]), r["n"]) for r in found.collect()) == sorted(
        (str(g), [float(len(d))]) for g, d in groups.items() for _ in d
    )
    assert {r["g"]: r["grain"] for r in ts.time_grain(df, "t", ["g"]).collect()} == {"a": "weekly", None: "monthly", "busy": "daily"}


def test_trends_without_crowded_groups_join_no_rows(spark, monkeypatch):
    """Groups to leave out are looked for first: without any, rows are not joined with all groups."""
    from tallyscope.operators import temporal

    def joined(*_):
        raise AssertionError("rows were joined")

    monkeypatch.setattr(temporal, "with_group_values", joined)
    df = grouped(spark, {"a": [0, 7, 14], None: [0, 30, 60, 90], "one": [5]})
    found = {r["g"]: (r["periods"], r["current_value"]) for r in ts.trends(df, ["g"], "t", ["v"]).collect()}
    assert found == {"a": (3, 3.0), None: (3, 7.0)}  # Jan 1 and 31, Mar 1 and 31
