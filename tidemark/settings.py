"""Parameters of the pipeline and the tables it keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """What a run may vary; the defaults are those of the operators."""

    search_days: int = 5
    lookahead_days: int = 3
    threshold_percent: float = 1.5
    min_chars: int = 50
    queue_items: int = 50
    lookback_days: int = 365
    alert_probability: float = 0.7


# The kept tables and their columns.
TABLES = {
    "news": "id BIGINT, title STRING, description STRING, content STRING, url STRING, published_at STRING, source_name STRING, content_hash STRING",
    "prices": "ticker STRING, time DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE",
    "sentiment": "news_id BIGINT, ticker STRING, created_at TIMESTAMP, sentiment_score DOUBLE",
    "predictions": "ticker STRING, time DATE, probability DOUBLE, predicted_direction INT, features_snapshot STRING",
    "alerts": "id BIGINT, ticker STRING, message STRING, created_at TIMESTAMP",
    "feedback": "prediction_id BIGINT, was_right BOOLEAN, note STRING, created_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str) -> list[str]:
    """Create the kept tables that are not there yet; returns their names."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")
    return sorted(TABLES)


def add_feedback(spark: SparkSession, database: str, prediction_id: int, was_right: bool, note: str | None = None) -> None:
    """Store what was said of a prediction."""
    row = spark.createDataFrame([(prediction_id, was_right, note)], "prediction_id long, was_right boolean, note string")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").insertInto(f"`{database}`.`feedback`")


def health(spark: SparkSession, database: str) -> dict[str, object]:
    """Whether the tables are there, and which are not."""
    there = {r["tableName"] for r in spark.sql(f"SHOW TABLES IN `{database}`").collect()} if spark.catalog.databaseExists(database) else set()
    missing = sorted(set(TABLES) - there)
    return {"status": "ok" if not missing else "incomplete", "missing": missing}


def table_counts(spark: SparkSession, database: str) -> DataFrame:
    """(table, n): rows of each kept table."""
    counts = [spark.table(f"`{database}`.`{name}`").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name in sorted(TABLES)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
