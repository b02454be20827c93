"""Numeric summaries, distributions, outliers, correlation."""

from __future__ import annotations

import tallyscope as ts
from checks.base import LINEITEM_NUMBERS, GAPPY, Check, gappy, r, read, rounded, stacked, with_t_tail
from pyspark.sql import functions as F
from tallyscope.functions import dagostino_p
from tallyscope.plans.moments import moments
from tallyscope.plans.table import Table

SUMMARY = ["column", "n", "mean", "median", "std", "min", "max", "skewness", "skew_interpretation"]


def summary_sql(source: str, columns, keys=()) -> str:
    k = "".join(x + ", " for x in keys)
    join = " AND ".join(["u.col = m.col", *(f"u.{x} = m.{x}" for x in keys)])
    uk = "".join(f"u.{x}, " for x in keys)
    skew = "avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5)"
    return f"""
    WITH u AS ({stacked(source, columns, keys)}),
    m AS (SELECT {k}col, avg(v) AS mu FROM u GROUP BY {k}col),
    s AS (SELECT {uk}u.col, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
            stddev_samp(v) AS std, min(v) AS lo, max(v) AS hi, {skew} AS skew
          FROM u JOIN m ON {join} GROUP BY {uk}u.col)
    SELECT {k}col AS "column", n, {r('mean', 4)} AS mean, {r('median', 4)} AS median,
        {r('std', 4)} AS std, lo AS "min", hi AS "max", {r('skew', 4)} AS skewness,
        CASE WHEN skew > 1 THEN 'right-skewed' WHEN skew < -1 THEN 'left-skewed'
             ELSE 'symmetric' END AS skew_interpretation
    FROM s WHERE n >= 10 AND lo < hi"""


def summary(df, by=(), **options):
    found = ts.numeric_summary(df, by, **options).select(*by, *SUMMARY)
    return rounded(found, mean=4, median=4, std=4, skewness=4)


def quantile_sql(source: str, columns, keys=()) -> str:
    k = "".join(x + ", " for x in keys)
    skew = "skew_m3 / pow(skew_m2, 1.5)"
    join = " AND ".join(["u.col = m.col", *(f"u.{x} = m.{x}" for x in keys)])
    uk = "".join(f"u.{x}, " for x in keys)
    return f"""
    WITH u AS ({stacked(source, columns, keys)}),
    m AS (SELECT {k}col, avg(v) AS mu FROM u GROUP BY {k}col),
    s AS (SELECT {uk}u.col, count(v) AS n, min(v) AS lo, max(v) AS hi,
            quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS q1,
            quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3,
            quantile_cont(v, 0.95) AS p95, kurtosis_pop(v) AS kurtosis,
            avg(pow(v - mu, 3)) AS skew_m3, avg(pow(v - mu, 2)) AS skew_m2
          FROM u JOIN m ON {join} GROUP BY {uk}u.col)
    SELECT {k}col AS "column", n, {r('q1', 4)} AS q1, {r('q2', 4)} AS q2, {r('q3', 4)} AS q3,
        {r('q3 - q1', 4)} AS iqr, {r('p5', 4)} AS p5, {r('p95', 4)} AS p95,
        {r('kurtosis', 4)} AS kurtosis, {r(skew, 4)} AS skewness,
        CASE WHEN kurtosis > 1 THEN 'heavy-tailed' WHEN kurtosis < -1 THEN 'light-tailed'
             ELSE 'normal-tailed' END AS kurtosis_interpretation
    FROM s WHERE n >= 30 AND lo < hi"""


SHAPE = ["column", "n", "q1", "q2", "q3", "iqr", "p5", "p95", "kurtosis", "skewness"]


def shape(df, by=(), **options):
    found = ts.distributions(df, by, **options).select(*by, *SHAPE, "kurtosis_interpretation")
    return rounded(found, **{c: 4 for c in SHAPE[2:]})


def normality(spark, sf):
    """The test as such, per customer, where its probabilities spread over 0 to 1."""
    t = Table(read(spark, sf, "orders").select("o_custkey", "o_totalprice"), ["o_custkey"])
    found = moments(t, ["o_totalprice"], ["n", "skewness", "kurtosis"]).where("n >= 20")
    p = dagostino_p("n", "skewness", "kurtosis")
    return found.select("o_custkey", "n", F.round(p, 5).alias("p_value"))


NORMALITY_SQL = f"""
    WITH m AS (SELECT o_custkey, avg(o_totalprice) AS mu FROM orders GROUP BY o_custkey),
    a AS (SELECT o.o_custkey, CAST(count(*) AS DOUBLE) AS n,
            avg(pow(o_totalprice - mu, 3)) / pow(avg(pow(o_totalprice - mu, 2)), 1.5) AS g1,
            avg(pow(o_totalprice - mu, 4)) / pow(avg(pow(o_totalprice - mu, 2)), 2) AS b2
          FROM orders o JOIN m ON o.o_custkey = m.o_custkey GROUP BY o.o_custkey
          HAVING count(*) >= 20),
    b AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
            -1 + sqrt(2*(3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) - 1)) AS w2,
            (b2 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
            6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS s FROM a),
    c AS (SELECT *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) AS z1,
            6+8/s*(2/s+sqrt(1+4/(s*s))) AS a FROM b),
    d AS (SELECT *, 1+x*sqrt(2/(a-4)) AS d FROM c),
    e AS (SELECT *, ((1-2/(9*a)) - sign(d)*cbrt((1-2/a)/abs(d)))/sqrt(2/(9*a)) AS z2 FROM d)
    SELECT o_custkey, CAST(n AS BIGINT) AS n, {r('exp(-(z1*z1+z2*z2)/2)', 5)} AS p_value FROM e"""


def fence_sql(source: str, columns, keys=()) -> str:
    k = "".join(x + ", " for x in keys)
    return f"""u AS ({stacked(source, columns, keys)}),
    f AS (SELECT {k}position, col, count(v) AS n, quantile_cont(v, 0.25) AS q1,
            quantile_cont(v, 0.75) AS q3 FROM u GROUP BY {k}position, col
          HAVING count(v) >= 30 AND min(v) < max(v)),
    g AS (SELECT {k}position, col, n, q1 - 1.5 * (q3 - q1) AS lower_bound,
            q3 + 1.5 * (q3 - q1) AS upper_bound FROM f)"""


def outlier_sql(source: str, columns, keys=()) -> str:
    k = "".join(x + ", " for x in keys)
    gk = "".join(f"g.{x}, " for x in keys)
    join = " AND ".join(["u.col = g.col", *(f"u.{x} = g.{x}" for x in keys)])
    return f"""WITH {fence_sql(source, columns, keys)},
    h AS (SELECT {gk}g.col, any_value(n) AS n, any_value(lower_bound) AS lower_bound,
            any_value(upper_bound) AS upper_bound, count(*) FILTER (v < lower_bound) AS low_count,
            count(*) FILTER (v > upper_bound) AS high_count
          FROM u JOIN g ON {join} GROUP BY {gk}g.col)
    SELECT {k}col AS "column", n, low_count + high_count AS outlier_count,
        {r('(low_count + high_count) * 100.0 / n', 4)} AS outlier_pct,
        {r('lower_bound', 4)} AS lower_bound, {r('upper_bound', 4)} AS upper_bound,
        low_count, high_count, CASE WHEN low_count > 0 AND high_count > 0 THEN 'both'
            WHEN high_count > 0 THEN 'high' ELSE 'low' END AS direction
    FROM h WHERE low_count + high_count > 0"""


EVENT_NUMBERS = [("event_id", 0), ("user_id", 2), ("value", 4)]
OUTLIERS = [
    "column", "n", "outlier_count", "outlier_pct", "lower_bound", "upper_bound", "low_count",
    "high_count", "direction",
]


def outliers(df, by=(), **options):
    found = ts.column_outliers(df, by, **options).select(*by, *OUTLIERS)
    return rounded(found, outlier_pct=4, lower_bound=4, upper_bound=4)


def examples(spark, sf):
    found = ts.outlier_examples(read(spark, sf, "events"), row_id="event_id")
    return found.select("column", "side", "rank", "row_index", "value")


EXAMPLES_SQL = f"""WITH {fence_sql('events', EVENT_NUMBERS)},
    w AS (SELECT 'event_id' AS col, event_id AS id, CAST(event_id AS DOUBLE) AS v FROM events
          UNION ALL SELECT 'user_id', event_id, CAST(user_id AS DOUBLE) FROM events
          UNION ALL SELECT 'value', event_id, value FROM events),
    x AS (SELECT w.*, CASE WHEN v < lower_bound THEN 'low' ELSE 'high' END AS side
          FROM w JOIN g ON w.col = g.col WHERE v < lower_bound OR v > upper_bound),
    y AS (SELECT *, row_number() OVER (PARTITION BY col, side
            ORDER BY CASE WHEN side = 'low' THEN v ELSE -v END, id) AS rank FROM x)
    SELECT col AS "column", side, CAST(rank AS INTEGER) AS rank, id AS row_index, v AS value
    FROM y WHERE rank <= 2"""


def changed_amounts(spark, sf):
    """Account balances as amounts, and as changes, which may be negative."""
    customer = read(spark, sf, "customer")
    return customer.select(
        "c_custkey",
        F.col("c_acctbal").alias("amount"),
        F.col("c_acctbal").alias("amount_change"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).otherwise(0).alias("item_count"),
    )


def suspicious(spark, sf):
    found = ts.suspicious_values(changed_amounts(spark, sf), row_id="c_custkey")
    return found.select(
        "column", "issue", "count", F.array_join(F.col("examples").cast("array<string>"), "|").alias("examples")
    )


SUSPICIOUS_SQL = """
    WITH z AS (SELECT count(*) FILTER (c_custkey % 7 = 0 OR c_nationkey = 0) AS zeros,
                 count(*) AS n FROM customer),
    b AS (SELECT count(*) FILTER (c_acctbal = 0) AS zeros, count(*) FILTER (c_acctbal < 0) AS neg,
            count(*) AS n FROM customer),
    e AS (SELECT string_agg(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_custkey) AS examples FROM
            (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0
             ORDER BY c_custkey LIMIT 3))
    SELECT 'amount' AS "column", 'unexpected_negatives' AS issue, neg AS count, examples
    FROM b, e WHERE neg > 0
    UNION ALL SELECT c.name, 'unexpected_zeros', zeros, '0.0' FROM b,
        (VALUES ('amount'), ('amount_change')) AS c(name) WHERE zeros > 0 AND zeros < 0.5 * n
    UNION ALL SELECT 'item_count', 'unexpected_zeros', zeros, '0.0' FROM z
        WHERE zeros > 0 AND zeros < 0.5 * n"""


def pair_sql(source: str, columns) -> str:
    """Pairwise-complete correlation of every two columns."""
    parts = []
    for i, (a, _) in enumerate(columns):
        for b, _ in columns[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
                f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
                f"corr({a}, {b}) AS r FROM {source}"
            )
    return f"""SELECT column_a, column_b, n, {r('r', 6)} AS r,
        CASE WHEN abs(r) < 0.3 THEN 'none' ELSE
            CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate'
                 ELSE 'weak' END || CASE WHEN r > 0 THEN '_positive' ELSE '_negative' END
        END AS strength, abs(r) > 0.9 AS is_collinear
    FROM ({" UNION ALL ".join(parts)})"""


def related(df):
    """lineitem figures with a strong and a moderate relation among them."""
    return df.select(
        "l_quantity",
        "l_extendedprice",
        (F.col("l_quantity") * 3 + F.col("l_discount") * 100).alias("weighted"),
        (-F.col("l_quantity") + F.col("l_linenumber") * 8).alias("net"),
        "l_discount",
    )


RELATED = (
    "(SELECT l_quantity, l_extendedprice, l_quantity * 3 + l_discount * 100 AS weighted, "
    "-l_quantity + l_linenumber * 8 AS net, l_discount FROM lineitem)"
)
RELATED_COLUMNS = [(c, 0) for c in ("l_quantity", "l_extendedprice", "weighted", "net", "l_discount")]


def pairs(df):
    found = ts.correlations(df).select("column_a", "column_b", "n", "r", "strength", "is_collinear")
    return rounded(found, r=6)


def significant(spark, sf):
    found = ts.significant_pairs(related(read(spark, sf, "lineitem")))
    return rounded(found.select("column_a", "column_b", "r", "strength", "interpretation"), r=6)


SIGNIFICANT_SQL = f"""SELECT column_a, column_b, r, strength,
    column_a || ' and ' || column_b || ' show ' || replace(strength, '_', ' ') || ' correlation'
        AS interpretation
    FROM ({pair_sql(RELATED, RELATED_COLUMNS)}) WHERE strength <> 'none'"""


def z_scores(spark, sf):
    return ts.z_score_outliers(read(spark, sf, "events")).select("column", "n", "z_count")


Z_SQL = f"""WITH u AS ({stacked('events', EVENT_NUMBERS)}),
    m AS (SELECT col, avg(v) AS mu, stddev_samp(v) AS sd FROM u GROUP BY col)
    SELECT u.col AS "column", count(*) AS n, count(*) FILTER (abs(v - mu) > 3 * sd) AS z_count
    FROM u JOIN m ON u.col = m.col GROUP BY u.col
    HAVING count(*) FILTER (abs(v - mu) > 3 * sd) > 0"""


def fences(spark, sf):
    found = ts.fences(read(spark, sf, "part")).select("column", "n", "lower_bound", "upper_bound")
    return rounded(found, lower_bound=4, upper_bound=4)


PART_NUMBERS = [("p_partkey", 0), ("p_size", 4), ("p_retailprice", 5)]
FENCES_SQL = f"""WITH {fence_sql('part', PART_NUMBERS)}
    SELECT col AS "column", n, {r('lower_bound', 4)} AS lower_bound,
        {r('upper_bound', 4)} AS upper_bound FROM g"""


PART_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, corr({a}, {b}) AS c FROM part"
    for i, (a, _) in enumerate(PART_NUMBERS)
    for b, _ in PART_NUMBERS[i + 1 :]
)
PART_T = f"SELECT *, n - 2e0 AS v, c * sqrt((n - 2) / (1 - c * c)) AS t FROM ({PART_PAIRS})"
P_VALUES_SQL = f"""SELECT column_a, column_b, n, {r('p', 6)} AS p_value, abs(c) >= 0.3 AND p < 0.05 AS is_significant
    FROM ({with_t_tail(PART_T, ["column_a", "column_b", "n", "c"])})"""


def shapiro(spark, sf):
    found = ts.shapiro_wilk(read(spark, sf, "customer"), ["c_mktsegment"])
    return rounded(found, w=6, p=6)


CHECKS = {
    "numeric_summary": Check(
        lambda s, d: summary(read(s, d, "lineitem")), summary_sql("lineitem", LINEITEM_NUMBERS)
    ),
    "numeric_summary_by": Check(
        lambda s, d: summary(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"]),
        summary_sql("lineitem", LINEITEM_NUMBERS, ["l_returnflag", "l_linestatus"]),
    ),
    "numeric_summary_missing_values": Check(
        lambda s, d: summary(gappy(s, d)), summary_sql(GAPPY, LINEITEM_NUMBERS)
    ),
    "numeric_summary_ranked": Check(
        lambda s, d: summary(read(s, d, "lineitem"), listed_values=0),
        summary_sql("lineitem", LINEITEM_NUMBERS),
    ),
    "distribution_quantiles": Check(
        lambda s, d: shape(read(s, d, "lineitem")), quantile_sql("lineitem", LINEITEM_NUMBERS)
    ),
    "distribution_quantiles_ranked": Check(
        lambda s, d: shape(gappy(s, d), listed_values=0), quantile_sql(GAPPY, LINEITEM_NUMBERS)
    ),
    "distribution_quantiles_by": Check(
        lambda s, d: shape(read(s, d, "events"), ["event_type"]),
        quantile_sql("events", EVENT_NUMBERS, ["event_type"]),
    ),
    "distribution_quantiles_by_ranked": Check(
        lambda s, d: shape(read(s, d, "events"), ["event_type"], listed_values=0),
        quantile_sql("events", EVENT_NUMBERS, ["event_type"]),
    ),
    "normality_dagostino": Check(normality, NORMALITY_SQL),
    "normality_shapiro": Check(shapiro),
    "outlier_fences": Check(fences, FENCES_SQL),
    "column_outliers": Check(
        lambda s, d: outliers(read(s, d, "events")), outlier_sql("events", EVENT_NUMBERS)
    ),
    "column_outliers_by": Check(
        lambda s, d: outliers(read(s, d, "events"), ["event_type"]),
        outlier_sql("events", EVENT_NUMBERS, ["event_type"]),
    ),
    "outlier_examples": Check(examples, EXAMPLES_SQL),
    "outlier_summary": Check(
        lambda s, d: rounded(ts.outlier_summary(read(s, d, "events")), outlier_pct=4),
        f"SELECT CAST(sum(outlier_count) AS BIGINT) AS total_outliers, "
        f"{r('sum(outlier_count) * 100.0 / (3 * (SELECT count(*) FROM events))', 4)} "
        f"AS outlier_pct FROM ({outlier_sql('events', EVENT_NUMBERS)})",
    ),
    "suspicious_values": Check(suspicious, SUSPICIOUS_SQL),
    "z_score_outliers": Check(z_scores, Z_SQL),
    "correlation_pairs": Check(
        lambda s, d: pairs(read(s, d, "lineitem")), pair_sql("lineitem", LINEITEM_NUMBERS)
    ),
    "correlation_pairs_missing_values": Check(
        lambda s, d: pairs(gappy(s, d)), pair_sql(GAPPY, LINEITEM_NUMBERS)
    ),
    "significant_pairs": Check(significant, SIGNIFICANT_SQL),
    "top_correlations": Check(
        lambda s, d: rounded(
            ts.top_correlations(related(read(s, d, "lineitem")), k=2).select("column_a", "column_b", "r"),
            r=6,
        ),
        f"SELECT column_a, column_b, r FROM ({SIGNIFICANT_SQL}) ORDER BY abs(r) DESC LIMIT 2",
    ),
    "correlation_p_values": Check(
        lambda s, d: ts.correlations(read(s, d, "part")).select(
            "column_a", "column_b", "n", F.round("p_value", 6).alias("p_value"),
            "is_significant",
        ),
        P_VALUES_SQL,
    ),
}
