"""Nearest-in-time matching of two tables that never share a timestamp.

The right side's moments become nearest-neighbour intervals: each reaches to the midpoints with its neighbours, and no
further than the tolerance. The left side is range-joined to them inside an index of time cells. As no moment farther
than the tolerance matters, each cell needs only its own moments and those within the tolerance of its borders; so a
key with a third of all rows is split by time, and a neighbour search never runs over a whole key.

Defined results: null and blank keys, and null times, match nothing. Of two moments equally near the earlier wins, of rows at one moment
the smallest id. Repeated left rows each get their match; an unmatched left row gets none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timestamps import price_moments, resolve_utc, stripped, with_moment

TOLERANCE_S = 7200


def neighbour_intervals(right: DataFrame, tolerance_s: int, cell_s: int) -> DataFrame:
    """(key, cell, lo, hi, id): for every moment of ``right`` (key, t, id) the seconds nearest to it, by time cell."""
    moments = right.where(F.col("key").isNotNull() & F.col("t").isNotNull()).groupBy("key", "t").agg(F.min("id").alias("id"))
    first, last = F.floor((F.col("t") - tolerance_s) / F.lit(cell_s)), F.floor((F.col("t") + tolerance_s) / F.lit(cell_s))
    spread = moments.withColumn("cell", F.explode(F.sequence(first, last)))
    w = Window.partitionBy("key", "cell").orderBy("t")
    middle = lambda a, b: a + F.floor((b - a) / F.lit(2))
    lo = F.greatest(F.col("t") - tolerance_s, middle(F.lag("t").over(w), F.col("t")) + 1)
    hi = F.least(F.col("t") + tolerance_s, middle(F.col("t"), F.lead("t").over(w)))
    return spread.select("key", "cell", lo.alias("lo"), hi.alias("hi"), "id")


def nearest_join(left: DataFrame, right: DataFrame, tolerance_s: int = TOLERANCE_S) -> DataFrame:
    """``left`` (with columns key, t) and ``id`` of the nearest row of ``right`` (key, t, id) within the tolerance."""
    cell_s = 4 * max(tolerance_s, 1)
    index = neighbour_intervals(right, tolerance_s, cell_s).withColumnsRenamed({"key": "__key", "cell": "__cell"})
    probes = left.withColumn("__at", F.floor(F.col("t") / F.lit(cell_s)))
    hit: Column = (F.col("key") == F.col("__key")) & (F.col("__at") == F.col("__cell")) & F.col("t").between(F.col("lo"), F.col("hi"))
    return probes.join(index, hit, "inner").drop("__at", "__key", "__cell", "lo", "hi")


def match_extractions(extractions: DataFrame, prices: DataFrame, companies: DataFrame, tolerance_s: int = TOLERANCE_S) -> DataFrame:
    """(extraction_id, price_id): each directly affected ticker's price row nearest to the extraction's article date.

    Rows whose ``article_date`` is null, empty or no moment, and null or blank tickers, match nothing. The article date has no
    home clock, so only dates that show their zone are moments.
    """
    rows = extractions.where(F.col("prediction").isNotNull()).select("extraction_id", F.col("prediction.data_quality.article_date").alias("__date"), F.col("prediction.directly_affected.ticker").alias("__tickers"))
    dated = with_moment(rows.where(F.col("__date").isNotNull()), F.col("__date"), F.lit(True), "__m").withColumn("__home", F.lit(None).cast("string"))
    dated = resolve_utc(dated, "__m", "__home", [], out="t").where(F.col("t").isNotNull())
    keys = F.array_distinct(F.transform("__tickers", lambda x: F.upper(stripped(x))))
    left = dated.select("extraction_id", "t", F.explode(keys).alias("key")).where(F.col("key") != "")
    right = price_moments(prices.select("price_id", "Stock Code", "Date"), companies).select(F.col("code").alias("key"), F.col("utc_second").alias("t"), F.col("price_id").alias("id")).where(F.col("key") != "")
    return nearest_join(left, right, tolerance_s).select("extraction_id", F.col("id").alias("price_id"))
