"""Demand per zone and window, against the baseline of the hour of the week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import measures, temporal
from zonecast.operators.enrich import small

WINDOW = "15 minutes"


def zone_demand(trips: DataFrame, window: str = WINDOW, mode: str = "both_sides", delay: str | None = None) -> DataFrame:
    """Pickups, dropoffs and pickup averages per window [start, end) and zone.

    Each trip becomes a pickup event and a dropoff event, so that one aggregation, with one shuffle and one state store,
    counts both; averages take pickup events alone. ``both_sides`` keeps the rows that have pickups and dropoffs,
    ``either_side`` all. A side without time or zone is left out, the other side of the trip stays.

    With a delay, the two kinds of event are watermarked apart, and the lesser watermark counts (the session's policy ``min``):
    a ride that ends hours after it began must not close the windows of the pickups that are still to come. Both branches read
    the same offsets of the stream, once each.
    """
    if mode not in ("both_sides", "either_side"):
        raise ValueError(f"unknown mode: {mode}")
    kept = ["trip_miles", "trip_time", "weather_temperature_c", "weather_precipitation_mm"]
    sides = {True: ("pickup_datetime", "PULocationID"), False: ("dropoff_datetime", "DOLocationID")}

    def event(pickup: bool) -> list[Column]:
        time, zone = sides[pickup]
        return [F.col(time).alias("at"), F.col(zone).alias("zone_id"), F.lit(pickup).alias("is_pickup")]

    if delay is None:
        events = trips.select(F.explode(F.array(*(F.struct(*event(k)) for k in sides))).alias("e"), *kept).select("e.*", *kept)
    else:
        picked, dropped = (trips.withWatermark(time, delay).select(*event(k), *kept) for k, (time, _) in sides.items())
        events = picked.union(dropped)
    events = events.na.drop(subset=["at", "zone_id"])

    def mean(value: Column) -> Column:
        return F.avg(F.when(F.col("is_pickup"), value))

    counted = events.groupBy(F.window("at", window).alias("w"), "zone_id").agg(
        F.count_if("is_pickup").cast("int").alias("pickup_count"),
        F.count_if(~F.col("is_pickup")).cast("int").alias("dropoff_count"),
        mean(F.col("trip_miles")).alias("avg_trip_miles"),
        mean(temporal.minutes(F.col("trip_time"))).alias("avg_trip_time"),
        mean(F.col("weather_temperature_c")).alias("avg_temperature"),
        mean(F.col("weather_precipitation_mm")).alias("precipitation_mm"),
    )
    if mode == "both_sides":
        counted = counted.where("pickup_count > 0 and dropoff_count > 0")
    return counted.select(F.col("w.start").alias("time_bucket"), *schemas.DEMAND.names[1:])


def attach_baseline(demand: DataFrame, baseline: DataFrame) -> DataFrame:
    """Demand with the mean of its zone and hour of the week, that mean's share of a window, and the ratio; unknown ones are null."""
    known = small(baseline.select(F.col("zone_id").alias("_zone"), F.col("hour_of_week").alias("_hour"), "baseline_mean_pickups"))
    hour = temporal.hour_of_week(F.col("time_bucket"))
    joined = demand.join(known, (F.col("zone_id") == F.col("_zone")) & (hour == F.col("_hour")), "left").drop("_zone", "_hour")
    scaled = joined.withColumn("demand_baseline", F.col("baseline_mean_pickups") * measures.WINDOW_SHARE)
    return scaled.withColumn("ratio", measures.guarded_ratio(F.col("pickup_count"), F.col("demand_baseline")))


def hotspots(rated: DataFrame) -> DataFrame:
    """The windows whose demand is a multiple of a baseline that is worth it, as alerts."""
    return rated.where(measures.is_hotspot(F.col("demand_baseline"), F.col("ratio"))).select(
        F.col("time_bucket").alias("detected_at"),
        "zone_id",
        F.col("pickup_count").alias("demand_current"),
        "demand_baseline",
        "ratio",
        measures.severity(F.col("ratio")).alias("severity"),
    )
