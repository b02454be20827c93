"""Intermediate tables of these operators, and their functions on the executors."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallyscope.plans.shared import shared_folder, written

__all__ = ["fresh", "map_batches", "on_workers", "shared_folder", "written"]

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def on_workers(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, wherever they start.

    On a cluster whose machines do not share that folder it is installed, or sent with --py-files.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def map_batches(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    on_workers(df.sparkSession)
    return df.mapInArrow(function, schema)
