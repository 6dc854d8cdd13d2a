"""Bring the package to the executors of a session.

Functions that run in Python workers are looked up by module.  Where the
package is not installed on the workers, its source goes with the session.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of the batches that go to Python workers: long texts in batches of the
#: default ten thousand rows would take hundreds of megabytes on either side.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Bound the batches of Python workers; send the package's source once a Spark application."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="strandline-"), "strandline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("strandline", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shipped(query: Callable[..., Any]) -> Callable[..., Any]:
    """A function of a session whose executors get the package first."""

    @wraps(query)
    def run(spark: SparkSession, *args: Any, **options: Any) -> Any:
        ship(spark)
        return query(spark, *args, **options)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark knows is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a folder to a place where nothing is."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    p = made(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, made(to)):
        raise OSError(f"{path} could not be moved to {to}")
