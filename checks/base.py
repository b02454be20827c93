"""Helpers for writing a query and its SQL side by side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})


def whole(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


def r(expression: str, digits: int) -> str:
    """Rounded SQL value, without negative zero."""
    return f"(round({expression}, {digits}) + 0e0)"


def stacked(source: str, columns: Sequence[str], keys: Sequence[str] = ()) -> str:
    """SQL for (keys, position, col, v): one row per value of each numeric column."""
    return " UNION ALL ".join(
        f"SELECT {''.join(k + ', ' for k in keys)}{position} AS position, '{name}' AS col, "
        f"CAST({name} AS DOUBLE) AS v FROM {source}"
        for name, position in columns
    )


def with_t_tail(source: str, columns: Sequence[str]) -> str:
    """SQL for ``columns`` of ``source`` and p, the two-sided tail of Student's t for its columns t and v
    (degrees of freedom): Simpson's rule over the density, at 4,000 steps from 0 to t."""
    names = ", ".join(columns)
    weight = "CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi() * v) * pow(1 + pow(h * i, 2) / v, -(v + 1) / 2)"
    return f"""SELECT {names}, greatest(0, 1 - 2 * any_value(h) / 3 * sum({weight} * {density})) AS p
    FROM (SELECT *, least(abs(t), 40) / 4000 AS h FROM ({source})), range(0, 4001) AS s(i) GROUP BY {names}"""


LINEITEM_NUMBERS = [
    ("l_orderkey", 0), ("l_partkey", 1), ("l_suppkey", 2), ("l_linenumber", 3),
    ("l_quantity", 4), ("l_extendedprice", 5), ("l_discount", 6), ("l_tax", 7),
]
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
ORDERS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
]

# lineitem with missing values: zeros and one flag become null
GAPPY = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, "
    "nullif(l_returnflag, 'A') AS l_returnflag, l_linestatus, l_shipdate FROM lineitem)"
)


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumns(
        {
            "l_discount": F.expr("nullif(l_discount, 0)"),
            "l_tax": F.expr("nullif(l_tax, 0)"),
            "l_returnflag": F.expr("nullif(l_returnflag, 'A')"),
        }
    )
