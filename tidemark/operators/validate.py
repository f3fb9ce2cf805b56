"""Validation of predictions as order-preserving arrays of messages, and the split into valid and invalid rows.

Predictions are taken as JSON, so that types are as replied: a confidence must be a number or a boolean in [0, 1], a group a
list. Defined results: a null prediction is ``prediction is not an object``; null and missing lists count as empty; null
entries are reported; a null where a value is required is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The permitted directions, impact types and event types.
DIRECTIONS = ("UP", "DOWN", "NEUTRAL")
IMPACT_TYPES = ("direct", "competitor", "sector_spillover", "supplier_chain", "regulatory")
EVENT_TYPES = ("earnings", "regulation", "product_launch", "disaster", "merger_acquisition", "macro", "legal", "management_change", "other")


GROUPS = ("directly_affected", "indirectly_affected")
# Fixed values, in the code below: the wording of the messages, by which callers tell the errors apart.
_NUMBERS = r"^(BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _unless(ok: Column, message: Column) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), message)


def _text(v: Column, field: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", "string")


def group_entries(record: Column, group: str) -> Column:
    """The entries of a group as variants; none where the group is no list."""
    return F.coalesce(F.try_variant_get(record, f"$.{group}", "array<variant>"), F.array().cast("array<variant>"))


def record_errors(record: Column, tickers: Column) -> Column:
    """Messages about one prediction as a variant; ``tickers`` is the array of known tickers."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    event = _text(record, "event_type")
    errors = [F.array(_unless(event.isin(*EVENT_TYPES), F.concat(F.lit("invalid event_type: "), shown(event))))]
    for group in GROUPS:

        def entry(e: Column, group: str = group) -> Column:
            t, direction, impact = _text(e, "ticker"), _text(e, "direction"), _text(e, "impact_type")
            kind = F.schema_of_variant(F.try_variant_get(e, "$.confidence", "variant"))
            return F.array(
                _unless(F.array_contains(tickers, t), F.concat(F.lit(f"invalid ticker in {group}: "), shown(t))),
                _unless(direction.isin(*DIRECTIONS), F.concat(F.lit("invalid direction for "), shown(t), F.lit(": "), shown(direction))),
                _unless(impact.isin(*IMPACT_TYPES), F.concat(F.lit("invalid impact_type for "), shown(t), F.lit(": "), shown(impact))),
                _unless(kind.rlike(_NUMBERS) & F.try_variant_get(e, "$.confidence", "double").between(0, 1), F.concat(F.lit("invalid confidence for "), shown(t))),
            )

        kind = F.coalesce(F.schema_of_variant(F.try_variant_get(record, f"$.{group}", "variant")), F.lit("VOID"))
        errors.append(F.array(F.when(~kind.rlike("^(ARRAY|VOID)"), F.lit(f"no list: {group}"))))
        errors.append(F.flatten(F.transform(group_entries(record, group), entry)))
    sides = [F.array_distinct(F.transform(group_entries(record, g), lambda e: _text(e, "ticker"))) for g in GROUPS]
    both = F.array_sort(F.array_intersect(*sides))
    errors.append(F.array(F.when(F.size(both) > 0, F.concat(F.lit("in both groups: "), F.array_join(both, ",", "None")))))
    listed = F.filter(F.concat(*errors), lambda x: x.isNotNull())
    return F.when(record.isNull(), F.array(F.lit("prediction is not an object"))).otherwise(listed)


def with_errors(rows: DataFrame, record: Column, companies: DataFrame) -> DataFrame:
    """``rows`` plus ``errors`` of their prediction as JSON text; the known tickers are one scalar subquery over the dimension."""
    known = companies.agg(F.sort_array(F.collect_set("ticker"))).scalar()
    prepared = rows.withColumn("__known", known).withColumn("__record", F.try_parse_json(record))
    return prepared.withColumn("errors", record_errors(F.col("__record"), F.col("__known"))).drop("__known", "__record")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows without and the invalid ones with their errors."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def price_row_valid(open_: Column, high: Column, low: Column, close: Column, volume: Column) -> Column:
    """Whether all five are there and not negative and low does not exceed high; NaN passes the comparisons."""
    present = [c.isNotNull() for c in (open_, high, low, close, volume)]
    fine = [F.isnan(c.cast("double")) | (c >= 0) for c in (open_, high, low, close, volume)]
    ordered = F.isnan(low.cast("double")) | F.isnan(high.cast("double")) | (low <= high)
    ok = ordered
    for c in (*present, *fine):
        ok = ok & c
    return F.coalesce(ok, F.lit(False))
