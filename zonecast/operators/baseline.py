"""The mean number of pickups per zone and hour of the week."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonecast.functions import measures, temporal
from zonecast.sources import tables

HOURS = 168
LEAST_WEEKS = 3


def complete_weeks(trips: DataFrame, time: str = "pickup_datetime") -> tuple[DataFrame, int]:
    """(trips of the weeks between the first and the last, number of those weeks); both ends go even if they are complete.

    Weeks start on Monday and are told apart by that date. They need the whole table: no stream, and one pass over the time column
    before the plan is built. Raises ValueError without trips or with fewer than three weeks.
    """
    week = temporal.week_start(F.col(time))
    span = trips.agg(F.min(week).alias("first"), F.max(week).alias("last"), F.count_distinct(week).alias("weeks")).first()
    if span["first"] is None:
        raise ValueError("no trips")
    if span["weeks"] < LEAST_WEEKS:
        raise ValueError(f"{span['weeks']} weeks are too few: {LEAST_WEEKS} are needed")
    return trips.where((week > F.lit(span["first"])) & (week < F.lit(span["last"]))), span["weeks"] - 2


def zone_hour_counts(trips: DataFrame, time: str = "pickup_datetime", zone: str = "PULocationID") -> DataFrame:
    known = trips.na.drop(subset=[time, zone])
    return known.groupBy(F.col(zone).alias("zone_id"), temporal.hour_of_week(F.col(time)).alias("hour_of_week")).agg(F.count(F.lit(1)).alias("pickups"))


def zone_hour_grid(spark: SparkSession, zones: DataFrame | int) -> DataFrame:
    """Every zone (a table with zone_id, or ids 1 to a number) with every hour of the week."""
    ids = spark.range(1, zones + 1).select(F.col("id").cast("int").alias("zone_id")) if isinstance(zones, int) else zones.select("zone_id").distinct()
    return ids.select("zone_id", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour_of_week"))


def zone_baseline(spark: SparkSession, trips: DataFrame, weeks: int, zones: DataFrame | int = 263) -> DataFrame:
    """A row for every zone and hour of the week: pickups by week, zero where there were none."""
    grid = zone_hour_grid(spark, zones)
    joined = grid.join(zone_hour_counts(trips), ["zone_id", "hour_of_week"], "left")
    return joined.select("zone_id", "hour_of_week", (F.coalesce("pickups", F.lit(0)) / F.lit(float(weeks))).alias("baseline_mean_pickups"))


def write_baseline(baseline: DataFrame, path: str) -> str:
    """The lookup that demand jobs read: one CSV file, ordered by zone and hour."""
    return tables.write_single_csv(baseline, path, order=("zone_id", "hour_of_week"))


def summary(baseline: DataFrame, exact: bool = True) -> DataFrame:
    """One row: cells, zones, hours, least, greatest, mean, p50, p90, p99, and the cells too low for alerts, with their percentage."""
    value = F.col("baseline_mean_pickups")

    def quantile(p: float):
        return F.percentile(value, F.lit(p)) if exact else F.percentile_approx(value, p, 1000)

    low = F.count_if(value < measures.ALERT_FLOOR)
    return baseline.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("zone_id").alias("zones"),
        F.count_distinct("hour_of_week").alias("hours"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.avg(value).alias("mean"),
        quantile(0.5).alias("p50"),
        quantile(0.9).alias("p90"),
        quantile(0.99).alias("p99"),
        low.alias("low_cells"),
        (100.0 * low / F.count(F.lit(1))).alias("low_percent"),
    )


def ranked_zones(baseline: DataFrame, count: int = 5, busiest: bool = True) -> DataFrame:
    """The zones of the greatest (or least) mean over all hours; equal means go by zone."""
    means = baseline.groupBy("zone_id").agg(F.avg("baseline_mean_pickups").alias("mean_pickups"))
    order = F.desc("mean_pickups") if busiest else F.asc("mean_pickups")
    return means.orderBy(order, "zone_id").limit(count)
