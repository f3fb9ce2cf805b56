"""Boosted trees over the feature frame, a model for each ticker, trained where the ticker's rows are.

A ticker's rows are a day each, so a group is bounded by the days of its history; all tickers are trained in parallel. The
trees are grown level by level over histograms of the features' quantiles, with the logistic loss and Newton leaf values.

Defined results: tickers with fewer than ``LEAST_ROWS`` rows get no model and no prediction; infinite features become the
largest float, as trees only compare; a ticker whose target never changes gets that target's rate; equal runs give equal
models.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import FEATURES, chronological_split, latest_features

# Rounds, depth and rate of the model, and the rows a ticker must have.
ROUNDS, TREE_DEPTH, RATE, LEAST_ROWS = 100, 3, 0.05, 50
BINS = 32
PENALTY = 1.0
MODEL = "ticker string, model string, accuracy double, n_train long, n_test long"


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    huge = np.finfo(float).max
    return np.clip(rows[FEATURES].to_numpy(float), -huge, huge)


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = TREE_DEPTH, rate: float = RATE) -> dict:
    """Boosted trees as plain lists: ``base`` and, for each tree, a level-order list of (feature, threshold) and leaf values."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(k)]
    bins = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])  # bin b: at most cut b
    offset = np.arange(k) * BINS
    rate0 = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate0 / (1 - rate0)))
    score, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node, splits = np.zeros(n, np.int64), []
        for level in range(depth):
            nodes = 1 << level
            cell = ((node * k)[:, None] * BINS + offset + bins).ravel()
            sums = [np.bincount(cell, np.repeat(w, k), nodes * k * BINS).reshape(nodes, k, BINS) for w in (g, h)]
            left_g, left_h = (s.cumsum(axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            for j, c in enumerate(cuts):
                gain[:, j, len(c) :] = -np.inf
            best = gain.reshape(nodes, -1).argmax(axis=1)
            feature, cut = best // BINS, best % BINS
            useful = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-12
            splits += [[int(f), float(cuts[f][c])] if u else [0, float(np.finfo(float).max)] for f, c, u in zip(feature, cut, useful, strict=True)]
            right = useful[node] & (bins[np.arange(n), feature[node]] > cut[node])
            node = node * 2 + right
        total_g, total_h = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf = -rate * total_g / (total_h + PENALTY)
        score = score + leaf[node]
        trees.append([splits, leaf.tolist()])
    return {"base": base, "depth": depth, "trees": trees}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability of a rise for each row."""
    score = np.full(len(x), model["base"])
    for splits, leaf in model["trees"]:
        node, first = np.zeros(len(x), np.int64), 0
        for level in range(model["depth"]):
            feature = np.array([s[0] for s in splits[first : first + (1 << level)]])
            cut = np.array([s[1] for s in splits[first : first + (1 << level)]])
            right = x[np.arange(len(x)), feature[node]] > cut[node]
            first += 1 << level
            node = node * 2 + right
        score += np.array(leaf)[node]
    return 1 / (1 + np.exp(-score))


def train(frame: DataFrame, rounds: int = ROUNDS, days: int | None = None) -> DataFrame:
    """(ticker, model, accuracy, n_train, n_test): the model of each ticker with enough rows, fitted on the first 80 % of
    them, and how often it is right on the rest. ``days`` limits the rows to that many days before the ticker's last."""
    if days is not None:
        last = frame.groupBy("ticker").agg(F.max("time").alias("__last"))
        frame = frame.join(last, "ticker").where(F.col("time") >= F.date_sub("__last", days)).drop("__last")
    rows = chronological_split(frame).select("ticker", "time", "target", "is_test", *FEATURES)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) < LEAST_ROWS:
            return pd.DataFrame([], columns=["ticker", "model", "accuracy", "n_train", "n_test"])
        part = part.sort_values("time")
        seen, held = part[~part["is_test"]], part[part["is_test"]]
        model = fit_trees(_matrix(seen), seen["target"].to_numpy(float), rounds)
        right = (probabilities(model, _matrix(held)) > 0.5) == (held["target"].to_numpy() == 1)
        return pd.DataFrame({"ticker": [part["ticker"].iloc[0]], "model": [json.dumps(model)], "accuracy": [float(right.mean())], "n_train": [len(seen)], "n_test": [len(held)]})

    return rows.groupBy("ticker").applyInPandas(one, MODEL)


def save(models: DataFrame, path: str) -> None:
    """Store models, a row a ticker; a later save of a path replaces the earlier."""
    models.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Stored models, of one ticker where one is named; empty where there are none."""
    try:
        models = spark.read.schema(MODEL).parquet(path)
    except AnalysisException:
        models = spark.createDataFrame([], MODEL)
    return models if ticker is None else models.where(F.col("ticker") == ticker)


def predict_latest(models: DataFrame, frame: DataFrame) -> DataFrame:
    """(ticker, time, probability, predicted_direction, features_snapshot) of each ticker's last row, by its own model."""
    rows = latest_features(frame).select("ticker", "time", *FEATURES).join(models.select("ticker", "model"), "ticker")
    schema = f"ticker string, time {dict(frame.dtypes)['time']}, " + ", ".join(f"{f} double" for f in FEATURES) + ", probability double"

    def score(it):
        for part in it:
            p = [float(probabilities(json.loads(m), _matrix(part.iloc[[k]]))[0]) for k, m in enumerate(part["model"])]
            yield part.drop(columns="model").assign(probability=p)

    scored = rows.select("ticker", "time", *[F.col(f).cast("double").alias(f) for f in FEATURES], "model").mapInPandas(score, schema)
    return scored.select("ticker", "time", "probability", (F.col("probability") > 0.5).cast("int").alias("predicted_direction"), F.to_json(F.struct(*FEATURES)).alias("features_snapshot"))
