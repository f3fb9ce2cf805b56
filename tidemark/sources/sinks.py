"""Sinks: partitioned tables, delimited and JSON files, appends with ids, and hooks for messages and counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_file_name


def write_securities(rows: DataFrame, path: str, security: str = "security") -> None:
    """One folder a security, its name made safe for files; each sorted by date."""
    named = rows.withColumn("file", safe_file_name(F.col(security)))
    named.repartition("file").sortWithinPartitions("file", "date").write.mode("overwrite").partitionBy("file").parquet(path)


def write_csv(rows: DataFrame, path: str, files: int | None = None) -> None:
    """Delimited files with a header; ``files`` limits their number where one small table is wanted."""
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row; the path carries the run's stamp."""
    rows.write.mode("errorifexists").json(path)


def append_with_ids(rows: DataFrame, path: str, order: list[str], id_col: str = "id") -> DataFrame:
    """Append ``rows`` with ids above those of the table and return them. Ids rise with the order within partitions of a
    range sort and are unique, without one task that sees all rows; they may have gaps."""
    spark = rows.sparkSession
    try:
        top = spark.read.parquet(path).agg(F.max(id_col)).first()[0]
    except AnalysisException:
        top = None
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(id_col, F.monotonically_increasing_id() + F.lit((top if top is not None else -1) + 1))
    numbered.write.mode("append").parquet(path)
    return spark.read.parquet(path).where(F.col(id_col) > (top if top is not None else -1))


def update_by_key(spark: SparkSession, path: str, new_path: str, changes: DataFrame, key: str) -> None:
    """Write the table at ``path`` to ``new_path`` with the rows of ``changes`` in place of those of their key."""
    old = spark.read.parquet(path)
    old.join(changes.select(key), key, "left_anti").unionByName(changes).write.mode("overwrite").parquet(new_path)


def notify(messages: DataFrame, send: Callable[[str], bool], column: str = "message", most: int = 100) -> int:
    """Send at most ``most`` messages, in their order, through ``send``; how many it took. Messages are a top-k by nature."""
    return sum(bool(send(r[0])) for r in messages.orderBy(column).select(column).limit(most).collect())


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` with a counter that is filled when an action reads them."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("n")), seen
