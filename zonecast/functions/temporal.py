"""Calendar columns. For TIMESTAMP they follow the session zone, for TIMESTAMP_NTZ the value's own wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WALL_CLOCK = "yyyy-MM-dd HH:mm:ss"
MORNING_RUSH, EVENING_RUSH = (7, 9), (16, 19)
SATURDAY, SUNDAY = 7, 1
FILE_MONTH = r"fhvhv_tripdata_(\d{4})-(\d{2})\.parquet"


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts).cast("smallint")


def day_of_week(ts: Column) -> Column:
    """1 is Sunday, 7 is Saturday."""
    return F.dayofweek(ts).cast("smallint")


def is_weekend(ts: Column) -> Column:
    return day_of_week(ts).isin(SUNDAY, SATURDAY)


def is_rush_hour(ts: Column) -> Column:
    """Weekdays, hours of the clock 7 to 9 and 16 to 19, both ends included."""
    hour = F.hour(ts)
    return ~is_weekend(ts) & (hour.between(*MORNING_RUSH) | hour.between(*EVENING_RUSH))


def wall_clock(ts: Column) -> Column:
    return F.date_format(ts, WALL_CLOCK)


def hour_of_week(ts: Column) -> Column:
    """0 is Monday's first hour, 167 Sunday's last."""
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("int")


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def week_start(ts: Column) -> Column:
    return F.date_trunc("week", ts)


def minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def parse_instant(text: Column) -> Column:
    """ISO text with or without an offset; null where it cannot be read."""
    return F.try_to_timestamp(text)


def file_month(path: Column) -> Column:
    """The first day of the month that a trip file's name states, null for other names."""
    return F.try_to_date(F.concat_ws("-", *(F.regexp_extract(path, FILE_MONTH, k) for k in (1, 2))), "yyyy-MM")


def month_series(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row (month date) for every month from first to last, both yyyy-MM and both included."""
    ends = [F.to_date(F.lit(m), "yyyy-MM") for m in (first, last)]
    return spark.range(1).select(F.explode(F.sequence(*ends, F.expr("interval 1 month"))).alias("month"))


def published_month(day: Column, lag_months: int = 2) -> Column:
    """The newest month that is out on a day, at a publication lag of whole months."""
    return F.add_months(F.trunc(day, "month"), -lag_months)


def missing_months(series: DataFrame, present: DataFrame) -> DataFrame:
    return series.join(present, "month", "left_anti")
