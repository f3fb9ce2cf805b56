"""Forward as-of join to daily prices and the labelling of predictions.

The probe side is exploded to its candidate days and equi-joined, then the earliest hit wins: a hash join on (ticker, day)
without a range condition. Probes are reduced to distinct (ticker, day) first, so hot tickers cost their distinct days.

Defined results: null tickers or days resolve to null prices; ties cannot occur as prices are unique on (ticker, day)
(``latest_prices`` makes them so); an empty price table gives null prices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import direction_label, percent_change, strict_day, to_number, trimmed
from tidemark.operators.validate import DIRECTIONS, GROUPS, group_entries

SEARCH_DAYS = 5


def latest_prices(raw: DataFrame, order: Column, ticker: str = "Stock Code", day: str = "Date", price: str = "Day's Final Price") -> DataFrame:
    """(ticker, day, price) from text rows: unreadable rows go, of repeated keys the last by ``order`` stays."""
    rows = raw.select(trimmed(F.col(ticker)).alias("ticker"), strict_day(trimmed(F.col(day))).alias("day"), to_number(F.col(price)).alias("price"), order.alias("o"))
    kept = rows.where((F.col("ticker") != "") & F.col("day").isNotNull() & F.col("price").isNotNull())
    return kept.groupBy("ticker", "day").agg(F.max_by("price", "o").alias("price"))


def resolve_keys(keys: DataFrame, prices: DataFrame, day: Column, found_day: str, found_price: str, search_days: int = SEARCH_DAYS) -> DataFrame:
    """``keys``, distinct rows with a ticker, plus the first price on ``day`` or up to ``search_days`` days later, and its
    day. Each key becomes its candidate days; one left hash join and one aggregation, and ``keys`` is read once."""
    spread = keys.withColumn("__at", F.explode_outer(F.transform(F.sequence(F.lit(0), F.lit(search_days)), lambda k: F.date_add(day, k))))
    known = prices.select(F.col("ticker").alias("__ticker"), F.col("day").alias("__found"), F.col("price").alias("__price"))
    joined = spread.join(known, (F.col("ticker") == F.col("__ticker")) & (F.col("__at") == F.col("__found")), "left")
    first = F.min(F.when(F.col("__found").isNotNull(), F.struct("__found", "__price")))
    hits = joined.groupBy(*keys.columns).agg(first.alias("__hit"))
    return hits.select(*keys.columns, F.col("__hit.__found").alias(found_day), F.col("__hit.__price").alias(found_price))


def forward_asof(probes: DataFrame, prices: DataFrame, day: str, found_day: str, found_price: str, search_days: int = SEARCH_DAYS) -> DataFrame:
    """``probes`` (with a ticker) plus the first price from their ``day`` on, and its day."""
    keys = probes.select("ticker", day).where(F.col("ticker").isNotNull() & F.col(day).isNotNull()).distinct()
    return probes.join(resolve_keys(keys, prices, F.col(day), found_day, found_price, search_days), ["ticker", day], "left")


def price_change(probes: DataFrame, prices: DataFrame, from_day: str, lookahead: int = 3, search_days: int = SEARCH_DAYS) -> DataFrame:
    """``probes`` plus price_t0 from ``from_day`` on, price_tn from ``lookahead`` days after the day found, and pct_change.

    Both searches run over the distinct (ticker, day) keys; the probes are joined to the result once.
    """
    keys = probes.select("ticker", from_day).where(F.col("ticker").isNotNull() & F.col(from_day).isNotNull()).distinct()
    first = resolve_keys(keys, prices, F.col(from_day), "t0_day", "price_t0", search_days)
    both = resolve_keys(first, prices, F.date_add("t0_day", lookahead), "tn_day", "price_tn", search_days)
    return probes.join(both, ["ticker", from_day], "left").withColumn("pct_change", percent_change(F.col("price_t0"), F.col("price_tn")))


def label_predictions(predictions: DataFrame, prices: DataFrame, from_day: str, direction: str, lookahead: int = 3, threshold: float = 1.5, require_price: bool = False) -> DataFrame:
    """``predictions`` plus prices, change, price_label and correct.

    A missing price labels NEUTRAL; ``require_price`` drops such rows. A direction that is none of the three is never correct.
    """
    moved = price_change(predictions, prices, from_day, lookahead)
    labelled = moved.withColumn("price_label", direction_label(F.col("pct_change"), threshold))
    right = F.col(direction).isin(*DIRECTIONS) & (F.col(direction) == F.col("price_label"))
    out = labelled.withColumn("correct", F.coalesce(right, F.lit(False)))
    return out.where(F.col("pct_change").isNotNull()) if require_price else out


def affected_entities(records: DataFrame, id_col: str = "extraction_id") -> DataFrame:
    """One row an affected company of (id_col, record as JSON text): (id_col, group, pos, article_date, ticker, company,
    impact_type, predicted_direction, predicted_confidence). A lone object counts as a list of one; null lists and entries
    give no rows."""
    v = F.col("__v")
    lists = []
    for group in GROUPS:
        one = F.try_variant_get(v, f"$.{group}", "variant")
        listed = F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)).otherwise(group_entries(v, group))
        lists.append(F.struct(F.lit(group).alias("group"), listed.alias("entries")))
    rows = records.select(id_col, F.try_parse_json("record").alias("__v")).select(id_col, "__v", F.inline(F.array(*lists)))
    each = rows.select(id_col, "group", F.try_variant_get(v, "$.data_quality.article_date", "string").alias("article_date"), F.posexplode("entries").alias("pos", "e")).where("e is not null and not is_variant_null(e)")
    text = lambda f: F.try_variant_get("e", f"$.{f}", "string")
    return each.select(id_col, "group", "pos", "article_date", text("ticker").alias("ticker"), text("company").alias("company"), text("impact_type").alias("impact_type"), text("direction").alias("predicted_direction"), F.try_variant_get("e", "$.confidence", "double").alias("predicted_confidence"))
