"""Semantic types, categorical summaries, key figures."""

from __future__ import annotations

import tallyscope as ts
from checks.base import LINEITEM, ORDERS, Check, r, read, rounded
from pyspark.sql import functions as F

ID_NAME = "(^id$|_id$|^uuid$|^guid$|^key$|_key$|^index$)"
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = {
    "integer": "c_custkey c_nationkey event_id user_id p_partkey p_size doc_id n_chars quality toxic "
    "o_orderkey o_custkey l_orderkey l_partkey l_suppkey l_linenumber conv_id turn",
    "float": "c_acctbal value p_retailprice o_totalprice l_quantity l_extendedprice l_discount l_tax",
    "temporal": "ts o_orderdate l_shipdate",
}
KIND = {c: kind for kind, names in KINDS.items() for c in names.split()}


def type_sql(table: str, columns) -> str:
    parts = []
    for i, c in enumerate(columns):
        kind = KIND.get(c, "string")
        if kind == "integer":
            rule = f"""CASE WHEN bool_and({c} IN (0, 1)) THEN 'boolean'
                WHEN count(DISTINCT {c}) > 100 AND count(DISTINCT {c}) > 0.5 * count(*) THEN 'id'
                ELSE 'numeric' END"""
        elif kind == "float":
            rule = f"CASE WHEN bool_and({c} IN (0, 1)) THEN 'boolean' ELSE 'numeric' END"
        elif kind == "temporal":
            rule = "'temporal'"
        else:
            many = f"(count(DISTINCT {c}) > 100 OR count(DISTINCT {c}) > 0.5 * count(*))"
            rule = f"""CASE WHEN {many} AND avg(length({c})) > 50 THEN 'text'
                WHEN {many} THEN 'id' ELSE 'categorical' END"""
        parts.append(
            f"SELECT {i} AS position, '{c}' AS col, count(*) AS row_count, "
            f"CASE WHEN regexp_matches('{c}', '{ID_NAME}') THEN 'id' ELSE {rule} END AS label "
            f"FROM {table}"
        )
    return f"""SELECT CAST(position AS INTEGER) AS position, col AS "column", label AS inferred_type,
        row_count, CAST({len(columns)} AS INTEGER) AS col_count FROM ({" UNION ALL ".join(parts)})"""


def profile(spark, sf, table):
    found = ts.schema_profile(read(spark, sf, table))
    return found.select("position", "column", "inferred_type", "row_count", "col_count")


def summary_sql(table: str, columns, by: str = "") -> str:
    key = f"{by}, " if by else ""
    parts = " UNION ALL ".join(
        f"SELECT {key}'{c}' AS col, {c} AS v, count(*) AS n FROM {table} GROUP BY {key}{c}"
        for c in columns
    )
    rows = f"(SELECT {key}count(*) AS rows_ FROM {table}{f' GROUP BY {by}' if by else ''})"
    join = f"s JOIN {rows} t USING ({by})" if by else f"s, {rows} t"
    return f"""
    WITH u AS ({parts}),
    k AS (SELECT *, row_number() OVER (PARTITION BY {key}col ORDER BY n DESC, v) AS rank FROM u),
    s AS (SELECT {key}col, count(*) AS cardinality, sum(n) AS total,
            sum(n) FILTER (rank <= 5) AS top, max(n) AS best FROM k GROUP BY {key}col),
    j AS (SELECT *, cardinality > 100 OR cardinality > 0.5 * rows_ AS high FROM {join})
    SELECT {key}col AS "column", cardinality, high AS is_high_cardinality,
        {r('CASE WHEN high THEN 100 ELSE (total - top) * 100.0 / total END', 4)} AS other_pct,
        CASE WHEN high THEN 'dispersed' WHEN best > 0.5 * total THEN 'high'
             WHEN best > 0.25 * total THEN 'moderate' ELSE 'dispersed' END AS concentration
    FROM j"""


def top_sql(table: str, columns) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {c} AS v, count(*) AS n FROM {table} GROUP BY {c}" for c in columns
    )
    return f"""
    WITH u AS ({parts}),
    k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS rank FROM u),
    s AS (SELECT col, count(*) AS cardinality, sum(n) AS total FROM u GROUP BY col)
    SELECT k.col AS "column", CAST(rank AS INTEGER) AS rank, v AS value, n AS count,
        {r('n * 100.0 / total', 4)} AS pct
    FROM k JOIN s ON k.col = s.col
    WHERE rank <= 5 AND cardinality <= 100 AND cardinality <= 0.5 * (SELECT count(*) FROM {table})"""


SUMMARY = ["column", "cardinality", "is_high_cardinality", "other_pct", "concentration"]


def summary(spark, sf, table, by=()):
    return rounded(ts.categorical_summary(read(spark, sf, table), by=by).select(*by, *SUMMARY), other_pct=4)


def top(spark, sf, table):
    found = ts.category_top_values(read(spark, sf, table)).drop("position")
    return rounded(found, pct=4)


def key_figures(spark, sf, table, by=()):
    found = ts.kpis(read(spark, sf, table), by=by)
    columns = ["rank", "name", "value", "text_value", "source_column", "computation", "confidence"]
    return rounded(found.select(*by, *columns), value=2)


def kpi_sql(entries, by: str = "", table: str = "") -> str:
    """entries: (name, value, text, source, computation, confidence) in order."""
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    parts = [
        f"SELECT {key}{i} AS seq, '{name}' AS name, {value} AS value, {text} AS text_value, "
        f"'{source}' AS source_column, '{how}' AS computation, {trust} AS confidence "
        f"FROM {table}{group}"
        for i, (name, value, text, source, how, trust) in enumerate(entries)
    ]
    over = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {key}CAST(rank AS INTEGER) AS rank, name, {r('CAST(value AS DOUBLE)', 2)} AS value,
        text_value, source_column, computation, CAST(confidence AS DOUBLE) AS confidence
    FROM (SELECT *, row_number() OVER ({over}ORDER BY confidence DESC, seq) AS rank
          FROM ({" UNION ALL ".join(parts)}) WHERE value IS NOT NULL OR text_value IS NOT NULL)
    WHERE rank <= 10"""


def date_entries(column: str) -> list:
    text = f"strftime(min({column}), '%b %Y') || ' – ' || strftime(max({column}), '%b %Y')"
    span = f"floor(epoch(max({column}) - min({column})) / 86400)"
    return [
        ("Date Range", "CAST(NULL AS DOUBLE)", text, column, "range", 0.95),
        ("Time Span", span, "CAST(NULL AS VARCHAR)", column, "range", 0.95),
    ]


NO_TEXT = "CAST(NULL AS VARCHAR)"
ORDER_KPIS = [
    ("Total Records", "count(*)", NO_TEXT, "_rows_", "count", 1.0),
    ("Total O Totalprice", "sum(o_totalprice)", NO_TEXT, "o_totalprice", "sum", 0.85),
    ("Avg O Totalprice", "avg(o_totalprice)", NO_TEXT, "o_totalprice", "mean", 0.8),
    *date_entries("o_orderdate"),
    ("Unique O Orderstatuss", "count(DISTINCT o_orderstatus)", NO_TEXT, "o_orderstatus", "count", 0.7),
    ("Unique O Orderprioritys", "count(DISTINCT o_orderpriority)", NO_TEXT, "o_orderpriority", "count", 0.7),
]
LINE_KPIS = [
    ("Total Records", "count(*)", NO_TEXT, "_rows_", "count", 1.0),
    ("Total L Linenumber", "sum(l_linenumber)", NO_TEXT, "l_linenumber", "sum", 0.8),
    ("Total L Quantity", "trunc(sum(l_quantity))", NO_TEXT, "l_quantity", "sum", 0.8),
    ("Total L Extendedprice", "sum(l_extendedprice)", NO_TEXT, "l_extendedprice", "sum", 0.85),
    ("Avg L Extendedprice", "avg(l_extendedprice)", NO_TEXT, "l_extendedprice", "mean", 0.8),
    ("Total L Discount", "trunc(round(sum(l_discount), 6))", NO_TEXT, "l_discount", "sum", 0.8),
    *date_entries("l_shipdate"),
    ("Unique L Linestatuss", "count(DISTINCT l_linestatus)", NO_TEXT, "l_linestatus", "count", 0.7),
]


def formatted(spark, sf):
    """Every order total in the short form, as money."""
    from tallyscope.functions import human_number

    orders = read(spark, sf, "orders")
    return orders.select("o_orderkey", human_number(F.col("o_totalprice"), True).alias("shown"))


FORMATTED_SQL = """SELECT o_orderkey, '$' || CASE
    WHEN o_totalprice >= 1e6 THEN printf('%.1fM', o_totalprice / 1e6)
    WHEN o_totalprice >= 1e3 THEN printf('%.1fK', o_totalprice / 1e3)
    ELSE printf('%.2f', o_totalprice) END AS shown FROM orders"""

TABLES = {
    "customer": CUSTOMER, "events": EVENTS, "part": PART, "documents": DOCUMENTS,
    "orders": ORDERS, "lineitem": LINEITEM, "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

CHECKS = {
    **{
        f"schema_profile_{name}": Check(
            lambda s, d, name=name: profile(s, d, name), type_sql(name, columns)
        )
        for name, columns in TABLES.items()
    },
    "type_summary": Check(
        lambda s, d: ts.type_summary(read(s, d, "events")),
        f"""SELECT label AS inferred_type, count(inferred_type) AS n_columns FROM (VALUES
            ('numeric'), ('categorical'), ('temporal'), ('text'), ('boolean'), ('id')) AS l(label)
        LEFT JOIN ({type_sql('events', EVENTS)}) ON label = inferred_type GROUP BY label""",
    ),
    "sample_values": Check(
        lambda s, d: ts.sample_values(read(s, d, "orders")).select(
            "column", F.array_join("sample_values", "|").alias("sample_values")
        )
    ),
    "categorical_summary": Check(
        lambda s, d: summary(s, d, "documents"), summary_sql("documents", ["text", "lang", "source"])
    ),
    "categorical_summary_part": Check(
        lambda s, d: summary(s, d, "part"), summary_sql("part", ["p_name", "p_brand", "p_type"])
    ),
    "categorical_summary_by": Check(
        lambda s, d: summary(s, d, "orders", ["o_orderstatus"]),
        summary_sql("orders", ["o_orderpriority"], "o_orderstatus"),
    ),
    "category_top_values": Check(
        lambda s, d: top(s, d, "part"), top_sql("part", ["p_name", "p_brand", "p_type"])
    ),
    "category_top_values_documents": Check(
        lambda s, d: top(s, d, "documents"), top_sql("documents", ["text", "lang", "source"])
    ),
    "kpis": Check(lambda s, d: key_figures(s, d, "orders"), kpi_sql(ORDER_KPIS, table="orders")),
    "kpis_by": Check(
        lambda s, d: key_figures(s, d, "lineitem", ["l_returnflag"]),
        kpi_sql(LINE_KPIS, "l_returnflag", "lineitem"),
    ),
    "human_number": Check(formatted, FORMATTED_SQL),
}
