import math
from statistics import NormalDist

import numpy as np
import pytest

import tallyscope as ts
from tallyscope.functions import dagostino_p, normal_quantile, normal_upper_tail, t_two_sided
from tests.conftest import by_key

# Two-sided 5 %, 1 % and 0.1 % points of Student's t
CRITICAL = [
    (1, 12.706, 0.05), (2, 4.303, 0.05), (3, 3.182, 0.05), (8, 2.306, 0.05), (10, 3.169, 0.01),
    (20, 2.845, 0.01), (30, 2.042, 0.05), (40, 2.021, 0.05), (60, 2.000, 0.05), (120, 1.980, 0.05),
    (30, 3.646, 0.001), (120, 3.373, 0.001),
]


def test_t_critical_values(spark):
    df = spark.createDataFrame([(t, float(k), p) for k, t, p in CRITICAL], "t double, k double, p double")
    for r in df.select("p", t_two_sided("t", "k").alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=2e-3)


def t_by_integration(t, k):
    angle = np.linspace(0, math.atan(t / math.sqrt(k)), 200_001)
    f = np.cos(angle) ** (k - 1)
    scale = math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) / math.sqrt(math.pi)
    return 1 - 2 * scale * float(np.sum((f[1:] + f[:-1]) / 2) * (angle[1] - angle[0]))


def test_t_against_integration_and_limits(spark):
    cases = [(t, float(k)) for k in (1, 2, 3, 4, 7, 20, 40, 41, 55, 400) for t in (0.0, 0.3, 1.7, 4.0)]
    df = spark.createDataFrame(cases, "t double, k double")
    for r in df.select("t", "k", t_two_sided("t", "k").alias("p")).collect():
        assert r["p"] == pytest.approx(t_by_integration(r["t"], r["k"]), abs=1e-8)
    edge = spark.createDataFrame(
        [(math.inf, 5.0), (-2.306, 8.0), (None, 3.0), (1.96, 1e9)], "t double, k double"
    )
    p = [r[0] for r in edge.select(t_two_sided("t", "k")).collect()]
    assert p[0] == 0 and p[1] == pytest.approx(0.05, rel=1e-3) and p[2] is None
    assert p[3] == pytest.approx(0.05, rel=1e-3)


def test_normal_functions(spark):
    z = [-6.0, -1.0, 0.0, 0.4, 0.66, 1.3, 2.0, 5.0, 6.0, 9.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    for r in df.select("z", normal_upper_tail("z").alias("p")).collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-13)
    p = [1e-6, 0.01, 0.07, 0.08, 0.5, 0.93, 0.9999]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    for r in df.select("p", normal_quantile("p").alias("z")).collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-10)


def royston(x):
    """Shapiro-Wilk by numpy, straight from the published formulas."""
    x = np.sort(x)
    n = len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = m @ m, 1 / math.sqrt(n)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    next_ = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
    eps = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
    a = m / math.sqrt(eps)
    a[-1], a[-2], a[0], a[1] = last, next_, -last, -next_
    w = (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()
    l = math.log(n)
    mu = 0.0038915 * l**3 - 0.083751 * l**2 - 0.31082 * l - 1.5861
    sigma = math.exp(0.0030302 * l**2 - 0.082676 * l - 0.4803)
    return w, 0.5 * math.erfc((math.log(1 - w) - mu) / sigma / math.sqrt(2))


@pytest.fixture(scope="module")
def samples(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    data = {"normal": rng.normal(5, 2, 300), "skew": rng.exponential(1, 300), "flat": rng.random(300)}
    return data, spark.createDataFrame(pd.DataFrame(data)).repartition(3)


def test_shapiro_against_the_formulas(samples):
    data, df = samples
    for c, r in by_key(ts.shapiro_wilk(df), "column").items():
        w, p = royston(data[c])
        assert r["w"] == pytest.approx(w, abs=1e-9) and r["p"] == pytest.approx(p, rel=1e-5)


def test_shapiro_rejects_five_percent_of_normal_samples(spark):
    df = spark.range(400 * 50).selectExpr("id % 400 AS g", "randn(11) AS x")
    found = ts.shapiro_wilk(df, ["g"]).where("p < 0.05").count()
    assert 8 <= found <= 34


def test_dagostino_against_the_formulas(spark):
    n, g1, g2 = 5000.0, 0.05, -0.12
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (g2 + 3 - e) / math.sqrt(v)
    s = 6 * (n**2 - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + math.sqrt(1 + 4 / s**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    z2 = ((1 - 2 / (9 * a)) - math.copysign(((1 - 2 / a) / abs(d)) ** (1 / 3), d)) / math.sqrt(2 / (9 * a))
    df = spark.createDataFrame([(5000, g1, g2)], "n bigint, s double, k double")
    got = df.select(dagostino_p("n", "s", "k").alias("p")).first()["p"]
    assert got == pytest.approx(math.exp(-(z1**2 + z2**2) / 2), rel=1e-10)


def test_normality_switch_at_5000(spark):
    df = spark.range(5000).selectExpr(
        "randn(5) AS big", "IF(id < 4999, randn(6), NULL) AS small", "-ln(rand(7)) AS skewed",
        "7.0 AS same", "IF(id < 29, randn(8), NULL) AS few",
    )
    found = by_key(ts.distributions(df), "column")
    assert set(found) == {"big", "small", "skewed"}
    assert found["skewed"]["distribution_type"] == "right-skewed" and not found["skewed"]["is_normal"]
    assert found["big"]["distribution_type"] == found["small"]["distribution_type"] == "normal"
    assert found["small"]["n"] == 4999 and list(by_key(ts.shapiro_wilk(df), "column")) == ["small"]


def test_distributions_are_empty_below_30(sales):
    assert ts.distributions(sales).count() == 0
