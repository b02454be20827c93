"""Intermediate tables in the folder that driver and executors share, and functions over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_folder: str | None = None
_written: dict[str, tuple[SparkSession, int]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where driver and tasks are one process."""
    global _own_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="tallyscope-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark, threading.get_ident())
    return path


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, survives lost executors.

    Every call has a folder of its own, so nothing old is ever read. ``paths`` gets the folder, for
    ``discard``; whatever is left goes when the process ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(schema).parquet(path)


def written_paths() -> set[str]:
    """Folders of the tables that this thread has written and that are still there."""
    return {path for path, (_, thread) in list(_written.items()) if thread == threading.get_ident()}


def discard(paths: list[str]) -> None:
    """Delete written tables; what was read from them cannot be read again."""
    for path in paths:
        spark, _ = _written.pop(path, (None, 0))
        if spark is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def _discard_all() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        discard(list(_written))


atexit.register(_discard_all)


def map_batches(df: DataFrame, function: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with a function of this package, which Python workers find where the driver did.

    On a cluster whose machines do not share that folder it is installed, or sent with --py-files.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return df.mapInArrow(function, schema)
