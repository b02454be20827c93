import math

import numpy as np
import pytest

import tallyscope as ts
from tallyscope.plans import quantiles as q
from tallyscope.plans.table import Table
from tests.conftest import by_key

GOLDEN = {
    ("sales10", "revenue"): (2050.05, 1950.0, 622.7315, 1350.0, 3100.0, 0.4861, "symmetric"),
    ("sales10", "units_sold"): (41.0, 39.0, 12.4544, 27, 62, 0.4864, "symmetric"),
    ("sales10", "discount_pct"): (8.5, 9.0, 3.504, 5, 15, 0.4247, "symmetric"),
    ("sales20", "revenue"): (2102.525, 2150.25, 802.5444, 150.0, 3300.0, -0.4798, "symmetric"),
    ("sales20", "units_sold"): (42.05, 43.0, 16.0508, 3, 66, -0.4797, "symmetric"),
    ("sales20", "discount_pct"): (11.6, 10.0, 9.9176, 5, 50, 3.0699, "right-skewed"),
}


def test_golden_summary(sales, sales10):
    for name, df in (("sales10", sales10), ("sales20", sales)):
        for column, r in by_key(ts.numeric_summary(df), "column").items():
            got = (r["mean"], r["median"], r["std"], r["min"], r["max"], r["skewness"])
            want = GOLDEN[name, column]
            assert got == pytest.approx(want[:6], abs=5e-5)
            assert r["skew_interpretation"] == want[6]


def test_too_few_constant_and_empty_columns(spark):
    data = [(float(i), 1.0, None, float(i) if i < 9 else None) for i in range(10)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    assert list(by_key(ts.numeric_summary(df), "column")) == ["a"]


def test_infinity_resets_mean_and_spread(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(math.inf,)], "x double")
    r = by_key(ts.numeric_summary(df), "column")["x"]
    assert (r["mean"], r["std"], r["skewness"]) == (0.0, 0.0, 0.0)
    assert r["max"] == math.inf and r["median"] == 5.0


def numbers():
    rng = np.random.default_rng(7)
    n = 60_000
    spread = rng.normal(100, 15, n)
    heavy = np.where(rng.random(n) < 0.34, 42.0, rng.exponential(50, n))  # a third is one value
    coarse = rng.integers(0, 7, n).astype(float)
    gaps = np.where(rng.random(n) < 0.3, np.nan, rng.gamma(2, 3, n))
    return {"spread": spread, "heavy": heavy, "coarse": coarse, "gaps": gaps}


@pytest.fixture(scope="module")
def many(spark):
    import pandas as pd

    columns = numbers()
    frame = pd.DataFrame(columns)
    frame["g"] = np.where(np.arange(len(frame)) % 3 == 0, "hot", [f"g{i % 40}" for i in range(len(frame))])
    return frame, spark.createDataFrame(frame).repartition(6).cache()


LEVELS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def test_ranked_quantiles_are_exact(many):
    frame, df = many
    t = Table(df.drop("g"))
    found = by_key(q.quantiles(t, t.numeric, LEVELS, listed_values=0), "column")
    for c in t.numeric:
        assert found[c]["q"] == pytest.approx(frame[c].quantile(LEVELS).tolist(), rel=1e-12)


@pytest.mark.parametrize("listed", [0, 3000, 1 << 20])
def test_passes_of_any_number_are_exact(spark, listed):
    """Values that differ in their last bits, powers of two, both signs, tiny, huge and infinite ones."""
    rng = np.random.default_rng(3)
    n = 20_000
    columns = {
        "last_bits": 1.0 + rng.integers(0, 3000, n) * 2.0**-52,
        "halves": np.ldexp(1.5, rng.integers(-1074, 1023, n)) * rng.choice([-1, 1], n),
        "edges": np.where(rng.random(n) < 0.5, 2.0**-1074, 1.7e308) * rng.integers(-1, 2, n),
        "endless": np.where(rng.random(n) < 0.3, np.inf, rng.normal(0, 1, n)),
        "zeros": rng.choice([0.0, -0.0, 1.0], n),
        "big": 2.0**53 + rng.integers(0, 1000, n),
    }
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    found = by_key(q.quantiles(Table(df), list(columns), LEVELS, listed_values=listed), "column")
    for c, values in columns.items():
        ordered = np.sort(values)
        for p, value in zip(LEVELS, found[c]["q"]):
            rank = (n - 1) * p
            low, high = ordered[math.floor(rank)], ordered[math.ceil(rank)]
            assert value == pytest.approx(low if low == high else low + (high - low) * (rank % 1), rel=1e-12)


def test_rounding_never_turns_the_order(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 5000), np.ldexp(rng.random(5000), rng.integers(-1080, 1020, 5000).astype(int))])
    values = np.sort(np.concatenate([values, -values, [0.0, math.inf, -math.inf, q.HUGE, np.nextafter(q.HUGE, 0)]]))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for bits in q.BITS:
        cells = [r.c for r in df.coalesce(1).select(q.leading(F.col("v"), bits).alias("c")).collect()]
        assert cells == sorted(cells) and (bits < 53 or cells == values.tolist())


def test_no_value_is_buffered_or_sorted_whole(many):
    """The first pass counts cells, not values: it hands on far fewer rows than it reads."""
    frame, df = many
    t = Table(df.select("spread"))
    values = t.df.selectExpr("0 AS position", "spread AS value")
    assert q._cells(values, ["position"], q.BITS[0]).count() < 100
    plan = q.quantiles(t, ["spread"], [0.5], listed_values=0)._jdf.queryExecution().toString()
    assert "percentile" not in plan


@pytest.mark.parametrize("broadcast", [32_000_000, 0])
def test_ranked_quantiles_per_group(many, monkeypatch, broadcast):
    from tallyscope.plans import table

    monkeypatch.setattr(table, "BROADCAST_BYTES", broadcast)
    frame, df = many
    t = Table(df, ["g"])
    found = by_key(q.quantiles(t, t.numeric, [0.25, 0.5], listed_values=0), "g", "column")
    want = frame.groupby("g").quantile([0.25, 0.5])
    for (g, c), r in found.items():
        assert r["q"] == pytest.approx(want.loc[g][c].tolist(), rel=1e-12)
    assert len(found) == frame.g.nunique() * 4


def test_order_and_partitions_do_not_matter(many):
    _, df = many
    one = by_key(ts.numeric_summary(df.drop("g").coalesce(1)), "column")
    other = by_key(ts.numeric_summary(df.drop("g").repartition(9, "spread")), "column")
    for c in one:
        for k, v in one[c].items():
            assert other[c][k] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v)


def test_null_group_keys_are_a_group(spark):
    data = [(None if i % 2 else "a", float(i)) for i in range(40)]
    found = by_key(ts.numeric_summary(spark.createDataFrame(data, "g string, x double"), ["g"]), "g")
    assert found["a"]["median"] == 19.0 and found[None]["median"] == 20.0


def test_decimals_and_big_integers(spark):
    df = spark.sql(
        "SELECT CAST(id AS DECIMAL(20, 2)) AS d, 9000000000000000000 + id AS big FROM range(20)"
    )
    found = by_key(ts.numeric_summary(df), "column")
    assert found["d"]["mean"] == 9.5 and found["big"]["n"] == 20
