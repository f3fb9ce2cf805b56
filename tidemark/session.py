"""A session with the settings this library is written for, and the package on its executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session the cluster gives."""
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once an application: the driver serves it to executors as Spark's own files."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tidemark-package-")
    atexit.register(shutil.rmtree, folder, True)  # executors that start late still fetch it from the driver
    with zipfile.ZipFile(f"{folder}/{package.name}_package.zip", "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, f"{package.name}/{source.relative_to(package)}")
    spark.sparkContext.addPyFile(z.filename)
    _SHIPPED.add(app)
