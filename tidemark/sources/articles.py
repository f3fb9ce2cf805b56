"""Articles of a news service, the knowledge graph of companies, tables named after securities, and generated prices.

No network code lives here: a fetch is a callable a caller supplies (see ``remote``), whose replies are stored as files, one
JSON reply a line, and read from there. Defined results: replies that are no JSON, or report anything but ``ok``, hold no
articles; without a credential nothing is read; null and missing fields become empty texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import safe_file_name, strip_share_suffix

# The fields of an article.
ARTICLE = ("title", "description", "content", "url", "published_at", "source_name")


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _replies(spark: SparkSession, path: str) -> DataFrame:
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    return lines.select(F.try_parse_json("value").alias("v"))


def _each(replies: DataFrame, field: str) -> DataFrame:
    return replies.select(F.explode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("e"))


def api_articles(spark: SparkSession, path: str, credential: str | None) -> DataFrame:
    """The articles (``ARTICLE``) of stored replies. The source is its name, be it an object or a text; the time of
    publication goes by either of its two names, the first one if it is there."""
    if not credential:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in ARTICLE))
    fine = _replies(spark, path).where(F.try_variant_get("v", "$.status", "string") == "ok")
    text = lambda f: F.try_variant_get("e", f"$.{f}", "string")
    stamp = F.when(F.array_contains(F.json_object_keys(F.to_json("e")), "published_at"), text("published_at")).otherwise(text("publishedAt"))
    source = F.when(F.schema_of_variant(F.try_variant_get("e", "$.source", "variant")).startswith("OBJECT"), text("source.name")).otherwise(text("source"))
    columns = {**{f: text(f) for f in ARTICLE[:4]}, "published_at": stamp, "source_name": source}
    return _each(fine, "articles").select(*[null_to_empty(c).alias(f) for f, c in columns.items()])


def search_request(name: str, ticker: str) -> str:
    """The search expression for one company."""
    return f'"{name}" OR "{ticker}"'


def graph_companies(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, name, sector) of the companies of a knowledge graph's JSON."""
    text = lambda f: F.try_variant_get("e", f"$.{f}", "string").alias(f)
    return _each(_replies(spark, path), "companies").select(text("ticker"), text("name"), text("sector"))


def file_tickers(tables: DataFrame, companies: DataFrame) -> DataFrame:
    """(file_stem, ticker) of tables named after a security, found by its name without the share class; null if unknown."""
    bare = lambda c: F.lower(strip_share_suffix(c))
    known = companies.select("ticker", bare(safe_file_name(F.col("name"))).alias("__k")).groupBy("__k").agg(F.min("ticker").alias("ticker"))
    return tables.join(known, bare(F.col("file_stem")) == F.col("__k"), "left").select("file_stem", "ticker")


def generated_prices(tickers: DataFrame, day: str, seed: int = 42) -> DataFrame:
    """(ticker, day, open, high, low, close, volume) made up for each ticker, the same for the same seed."""
    u = lambda k: F.pmod(F.xxhash64("ticker", F.lit(day), F.lit(seed + k)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    base = 10 + 140 * u(1)
    volume = (1000 + F.floor(499_001 * u(3))).cast("long")
    return tickers.select("ticker", F.to_date(F.lit(day)).alias("day"), base.alias("open"), (base * 1.05).alias("high"), (base * 0.95).alias("low"), (base * (0.98 + 0.05 * u(2))).alias("close"), volume.alias("volume"))
