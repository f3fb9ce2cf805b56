"""Classification metrics of labelled predictions. All breakdowns are partial aggregations with small results.

Defined results: an empty input gives zeros where a spine exists (bands, classes) and no rows elsewhere; null ``correct``
counts as wrong; null or NaN confidences are left out of the bands, null or empty groups count as ``unknown``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import share
from tidemark.operators.asof import DIRECTIONS

# The names of the confidence bands.
BANDS = ("low (<0.50)", "medium (0.50-0.70)", "high (>0.70)")


def _right(c: str = "correct"):
    return F.count_if(F.coalesce(F.col(c), F.lit(False)))


def overall(rows: DataFrame) -> DataFrame:
    """(total_predictions, overall_accuracy)."""
    return rows.agg(F.count("*").alias("total_predictions"), F.round(share(_right(), F.count("*")), 4).alias("overall_accuracy"))


def confusion(rows: DataFrame, predicted: str = "predicted_direction", actual: str = "price_label", classes: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """(class, tp, fp, fn) over the rows whose two values are both known classes; one pass, classes as columns."""
    known = rows.where(F.col(predicted).isin(*classes) & F.col(actual).isin(*classes))
    counts = []
    for k, c in enumerate(classes):
        p, a = F.col(predicted) == c, F.col(actual) == c
        counts += [F.count_if(p & a).alias(f"tp{k}"), F.count_if(p & ~a).alias(f"fp{k}"), F.count_if(~p & a).alias(f"fn{k}")]
    one = known.agg(*counts)
    each = F.array(*[F.struct(F.lit(c).alias("class"), *[F.col(f"{n}{k}").alias(n) for n in ("tp", "fp", "fn")]) for k, c in enumerate(classes)])
    return one.select(F.inline(each))


def precision_recall_f1(rows: DataFrame, predicted: str = "predicted_direction", actual: str = "price_label", classes: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """(class, precision, recall, f1, support), rounded only at the end."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = F.col("p"), F.col("r")
    scored = confusion(rows, predicted, actual, classes).select("class", share(tp, tp + fp).alias("p"), share(tp, tp + fn).alias("r"), (tp + fn).alias("support"))
    return scored.select("class", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(share(2 * p * r, p + r), 4).alias("f1"), "support")


def by_confidence(rows: DataFrame, confidence: str = "predicted_confidence") -> DataFrame:
    """(band, accuracy, n) of all three bands."""
    c = F.col(confidence)
    usable = rows.where(c.isNotNull() & ~F.isnan(c.cast("double")))
    inside = {BANDS[0]: c < 0.5, BANDS[1]: (c >= 0.5) & (c <= 0.7), BANDS[2]: c > 0.7}
    good = F.coalesce(F.col("correct"), F.lit(False))
    one = usable.agg(*[f for k, x in enumerate(inside.values()) for f in (F.count_if(x).alias(f"n{k}"), F.count_if(x & good).alias(f"c{k}"))])
    each = F.array(*[F.struct(F.lit(b).alias("band"), F.round(share(F.col(f"c{k}"), F.col(f"n{k}")), 4).alias("accuracy"), F.col(f"n{k}").alias("n")) for k, b in enumerate(inside)])
    return one.select(F.inline(each))


def by_group(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(group, accuracy, n) of a column's values, sorted by value; or of its ``top`` most frequent values, ties by value."""
    group = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown"))
    out = rows.groupBy(group.alias("group")).agg(F.round(share(_right(), F.count("*")), 4).alias("accuracy"), F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "group").limit(top) if top else out.orderBy("group")


def distribution(values: DataFrame, column: str, classes: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """(class, n) of every class, zeros included."""
    one = values.agg(*[F.count_if(F.col(column) == c).alias(f"n{k}") for k, c in enumerate(classes)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"n{k}").alias("n")) for k, c in enumerate(classes)])))
