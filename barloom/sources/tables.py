"""Reading the tables of a folder, and cutting a plan by a table written to the shared folder."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context, so that they need no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_barloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    out.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    path = f"{shared_folder(spark)}/barloom-{uuid.uuid4().hex}.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(packed.getvalue()))
    out.close()
    atexit.register(_delete, spark, path)
    context.addPyFile(path)
    context._barloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of `folder`; columns and filters are pushed into the scan by Catalyst."""
    shipped(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a local master gets a temporary folder of its own; a cluster gets an error, since a
    machine-local folder is not seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not (own := getattr(context, "_barloom_folder", None)):
        own = context._barloom_folder = "file://" + tempfile.mkdtemp(prefix="barloom-")
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a parquet table in the shared folder and read back, so that its lineage ends there.

    The plan above is not computed twice, and a lost executor costs a read, not the stages before. The table is
    deleted at the end of the `scratch` around the call, or else when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    else:
        atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


_scratches: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are `written` inside are deleted at its end: results must be read or saved before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before
        pass
