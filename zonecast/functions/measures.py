"""Numbers derived from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of an hour that a demand window covers.
WINDOW_SHARE = 0.25
ALERT_FLOOR, WARNING_RATIO, CRITICAL_RATIO = 1.0, 2.0, 3.0


def guarded_ratio(count: Column, base: Column) -> Column:
    """count / base where base is above zero, else null: never zero, infinite or an error."""
    return F.when(base > 0, count / base)


def severity(ratio: Column) -> Column:
    return F.when(ratio >= CRITICAL_RATIO, F.lit("critical")).otherwise(F.lit("warning"))


def is_hotspot(base: Column, ratio: Column) -> Column:
    """Null ratios and bases are no hotspots."""
    return (base >= ALERT_FLOOR) & (ratio >= WARNING_RATIO)


def missing_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
