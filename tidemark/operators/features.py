"""Technical features of daily prices and their join to daily sentiment; one job over all tickers.

Rolling features share one window over (ticker, time), so there is one shuffle and one sort. The recursive mean of the
RSI runs in Arrow over each ticker's sorted rows and carries its state, so it is linear in the length of a series.

Defined results: null closes give null features; a flat series has no RSI (0/0) and its rows drop out; zero volumes give
infinite changes, which stay; a ticker without any sentiment has 0.0 in both score columns on every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ieee_divide

# The features, in the order of the model.
FEATURES = ["ret_1d", "ret_5d", "ret_20d", "vol_change", "sma_20", "rsi_14", "score", "score_trend_3d"]
WARMUP_DAYS, SENTIMENT_DAYS = 60, 10


def _over(ticker: str, time: str):
    return Window.partitionBy(ticker).orderBy(time)


def change(c: str, n: int, w) -> Column:
    """Relative change against ``n`` rows before."""
    old = F.lag(c, n).over(w)
    return ieee_divide(F.col(c).cast("double"), old.cast("double")) - 1


def rolling_mean(c: str, n: int, w) -> Column:
    """Mean of the last ``n`` rows; null until there are ``n`` values."""
    rows = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(rows) == n, F.avg(c).over(rows))


def returns(prices: DataFrame, ticker: str = "ticker", time: str = "time") -> DataFrame:
    """``prices`` (close, volume) plus ret_1d, ret_5d, ret_20d, vol_change and sma_20."""
    w = _over(ticker, time)
    return prices.withColumns({"ret_1d": change("close", 1, w), "ret_5d": change("close", 5, w), "ret_20d": change("close", 20, w), "vol_change": change("volume", 1, w), "sma_20": rolling_mean("close", 20, w)})


def rsi(prices: DataFrame, ticker: str = "ticker", time: str = "time", com: float = 13.0, out: str = "rsi_14") -> DataFrame:
    """``prices`` plus the RSI: gains and losses averaged with weight 1 / (1 + com), seeded with the first difference.

    Rows are sorted by (ticker, time) within hash partitions of whole tickers and read in Arrow batches; the running
    averages are carried from batch to batch, so no series is held in memory as a whole.
    """
    alpha = 1.0 / (1.0 + com)
    w = _over(ticker, time)
    delta = F.col("close") - F.lag("close").over(w)
    stepped = prices.withColumn("__delta", delta)
    ordered = stepped.repartition(F.col(ticker)).sortWithinPartitions(ticker, time)
    kept = prices.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in prices.dtypes) + f", `{out}` double"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, up, down = object(), None, None
        for part in it:
            result = []
            for k, d in zip(part[ticker].tolist(), part["__delta"].tolist(), strict=True):
                if k != key:
                    key, up, down = k, None, None
                if d is not None and d == d:
                    gain, loss = max(d, 0.0), max(-d, 0.0)
                    up = gain if up is None else (1 - alpha) * up + alpha * gain
                    down = loss if down is None else (1 - alpha) * down + alpha * loss
                if up is None or (up == 0 and down == 0):
                    result.append(None)
                elif down == 0:
                    result.append(100.0)
                else:
                    result.append(100.0 - 100.0 / (1.0 + up / down))
            yield part[kept].assign(**{out: pd.array(result, dtype="Float64")})

    return ordered.mapInPandas(run, schema)


def next_day_target(prices: DataFrame, ticker: str = "ticker", time: str = "time") -> DataFrame:
    """``prices`` plus target: 1 if the next close is higher, else 0; the last row is 0."""
    nxt = F.lead("close").over(_over(ticker, time))
    return prices.withColumn("target", F.coalesce((nxt > F.col("close")).cast("int"), F.lit(0)))


def daily_sentiment(scores: DataFrame, ticker: str = "ticker", at: str = "created_at", score: str = "sentiment_score") -> DataFrame:
    """(ticker, time, score): mean score of each ticker and day."""
    return scores.groupBy(F.col(ticker), F.to_date(at).alias("time")).agg(F.avg(score).alias("score"))


def feature_frame(prices: DataFrame, scores: DataFrame, start, end) -> DataFrame:
    """All features and the target of every ticker from ``start`` to ``end`` (dates); rows with a missing feature drop out
    before the warm-up rows are trimmed."""
    start, end = F.lit(start).cast("date"), F.lit(end).cast("date")
    near = prices.where(F.col("time").between(F.date_sub(start, WARMUP_DAYS), end)).select("ticker", "time", "close", "volume")
    heard = scores.where(F.to_date("created_at").between(F.date_sub(start, SENTIMENT_DAYS), end))
    daily = daily_sentiment(heard)
    any_score = daily.select("ticker").distinct().withColumn("__any", F.lit(True))
    base = next_day_target(returns(rsi(near)))
    joined = base.join(daily, ["ticker", "time"], "left").join(any_score, "ticker", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    trend = rolling_mean("score", 3, _over("ticker", "time"))
    full = joined.withColumn("score_trend_3d", F.when(F.col("__any"), trend).otherwise(F.lit(0.0))).drop("__any")
    return full.dropna(subset=["close", "volume", *FEATURES, "target"]).where(F.col("time") >= start)


def latest_features(frame: DataFrame) -> DataFrame:
    """The last row of each ticker."""
    return frame.groupBy("ticker").agg(F.max_by(F.struct(*[c for c in frame.columns if c != "ticker"]), "time").alias("x")).select("ticker", "x.*")


def chronological_split(frame: DataFrame, test_share: float = 0.2) -> DataFrame:
    """``frame`` plus is_test: the last ceil(test_share * n) rows of each ticker."""
    w = _over("ticker", "time")
    n = F.count("*").over(Window.partitionBy("ticker"))
    return frame.withColumn("is_test", F.row_number().over(w) > n - F.ceil(n * test_share))


def trainable_tickers(frame: DataFrame, least: int = 50) -> DataFrame:
    """(ticker, n) of the tickers with enough rows to train on."""
    return frame.groupBy("ticker").agg(F.count("*").alias("n")).where(F.col("n") >= least)
