"""CSV files that Spark writes from a table, read back; dates that are texts."""

from __future__ import annotations

import tallyscope as ts
from checks.base import Check, read
from checks.times import grain_sql
from pyspark.sql import functions as F
from tallyscope.plans.shared import new_folder


def csv_of(df, **options):
    """The table as read from CSV files that hold it."""
    path = new_folder(df.sparkSession, "csv")
    df.write.option("header", True).option("escape", '"').options(**options).csv(path)
    return ts.read_csv(df.sparkSession, path).df


def orders_from_csv(spark, sf):
    """Every inferred type, with missing tokens, empty fields, quotes and separators inside fields."""
    orders = read(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 == 0, "N/A").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false").alias("is_final"),
        F.concat(F.lit('say ",'), F.col("o_orderpriority"), F.lit('"')).alias("priority"),
        F.lit(None).cast("string").alias("nothing"),
    )
    found = csv_of(orders)
    assert "nothing" not in found.columns  # columns without a value are dropped
    return found


ORDERS_SQL = """SELECT o_orderkey, CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey AS BIGINT) END AS customer,
        CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price, o_orderstatus = 'F' AS is_final,
        'say ",' || o_orderpriority || '"' AS priority FROM orders"""


def text_dates(spark, sf):
    return read(spark, sf, "orders").select(
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("ordered"), F.col("o_totalprice").alias("price")
    )


def text_date_types(spark, sf):
    return ts.schema_profile(text_dates(spark, sf)).select("column", "inferred_type", "physical_type", "row_count")


TYPES_SQL = """WITH v AS (SELECT strftime(o_orderdate, '%m/%d/%Y') AS ordered FROM orders)
    SELECT 'ordered' AS "column", CASE WHEN count(try_strptime(ordered, '%m/%d/%Y')) > 0.8 * count(*) THEN 'temporal'
        ELSE 'categorical' END AS inferred_type, 'string' AS physical_type, count(*) AS row_count FROM v
    UNION ALL SELECT 'price', 'numeric', 'double', count(*) FROM orders"""

CHECKS = {
    "read_csv_orders": Check(orders_from_csv, ORDERS_SQL),
    "schema_profile_text_dates": Check(text_date_types, TYPES_SQL),
    "time_grain_text_dates": Check(
        lambda s, d: ts.time_grain(text_dates(s, d)).select("n", "grain"), grain_sql("orders", "o_orderdate")
    ),
}
