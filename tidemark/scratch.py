"""Intermediate tables in the folder all executors share.

A written table cuts the lineage, survives the loss of executors and is computed once, whereas ``checkpoint()``
would run its plan a second time. The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset in a local
run, as in tests, a folder of our own is made. What an application wrote is deleted when its driver ends, so that the
cluster's folder does not fill up; results that must last are written elsewhere by whoever asked for them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ROOTS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from the session's ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _OWN["dir"], True)
    return f"file://{_OWN['dir']}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the application's part of the shared folder."""
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_clear, spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _clear(spark: SparkSession, root: str) -> None:
    try:
        remove(spark, root)
    except Exception:  # noqa: BLE001 - the session may have ended before; nothing depends on it
        return


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return a DataFrame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
