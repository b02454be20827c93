from __future__ import annotations

import os
import re
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import tallyscope as ts  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = ts.session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sales_text() -> str:
    """The 20-row sample of FIXTURES.md."""
    with open(os.path.join(ROOT, "FIXTURES.md"), encoding="utf-8") as f:
        return re.search(r"```csv\n(.*?)```", f.read(), re.S).group(1)


@pytest.fixture(scope="session")
def sales(spark, sales_text, tmp_path_factory):
    path = tmp_path_factory.mktemp("sales") / "sales.csv"
    path.write_text(sales_text)
    return ts.read_csv(spark, str(path)).df.cache()


@pytest.fixture(scope="session")
def sales10(sales):
    return sales.where("date <= '2025-01-05'")


def rows(df, *order):
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def by_key(df, *keys):
    found = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        found[key[0] if len(keys) == 1 else key] = r.asDict(recursive=True)
    return found
