"""The star-schema tables in the roles of the pipeline's inputs.

Daily prices come from lineitem by supplier and ship date, predictions and sentiment from orders, the stock's dimension from
supplier. Money is summed as decimal and cast once, so results do not depend on the order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import table


def _money(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, day, close, high, low, volume): volume-weighted price, extremes and volume of each supplier and day."""
    rows = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 0) & F.col("l_shipdate").isNotNull())
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    qty = _money(F.col("l_quantity"))
    return rows.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("day")).agg(
        (_money(F.col("l_extendedprice")) / qty).alias("close"), F.max(unit).alias("high"), F.min(unit).alias("low"), qty.alias("volume")
    )


def asof_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, day, price)."""
    return daily_prices(spark, sf_dir).select("ticker", "day", F.col("close").alias("price"))


def _ticker(spark: SparkSession, sf_dir: str) -> Column:
    n = table(spark, sf_dir, "supplier").count()
    return F.pmod(F.col("o_custkey"), F.lit(max(n, 1))).cast("string")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ticker, article_day, predicted_direction, predicted_confidence, impact_type) from orders."""
    p = F.substring("o_orderpriority", 1, 1)
    direction = F.when(p < "3", "UP").when(p < "5", "DOWN").otherwise("NEUTRAL")
    confidence = (F.col("o_orderkey") * 37 % 101) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), _ticker(spark, sf_dir).alias("ticker"), F.to_date("o_orderdate").alias("article_day"),
        direction.alias("predicted_direction"), confidence.alias("predicted_confidence"), F.col("o_orderstatus").alias("impact_type"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, created_at, sentiment_score) from orders."""
    score = ((F.col("o_orderkey") * 37) % 201 - 100) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select(_ticker(spark, sf_dir).alias("ticker"), F.col("o_orderdate").alias("created_at"), score.alias("sentiment_score"))
