"""Flows between zones and the weighted degrees of their network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = "1 hour"


def od_flows(trips: DataFrame, window: str = WINDOW, delay: str | None = None) -> DataFrame:
    """Trips per window [start, end), origin and destination; trips that lack one of the three are left out, loops stay."""
    known = trips.na.drop(subset=["pickup_datetime", "PULocationID", "DOLocationID"])
    if delay is not None:
        known = known.withWatermark("pickup_datetime", delay)
    counted = known.groupBy(
        F.window("pickup_datetime", window).alias("w"), F.col("PULocationID").alias("origin_zone_id"), F.col("DOLocationID").alias("dest_zone_id")
    ).agg(F.count(F.lit(1)).cast("int").alias("trip_count"))
    return counted.select(F.col("w.start").alias("time_window"), "origin_zone_id", "dest_zone_id", "trip_count")


def with_degrees(flows: DataFrame) -> DataFrame:
    """Flows with the trips into their destination and out of their origin in the whole window; a loop counts in both."""
    into = Window.partitionBy("time_window", "dest_zone_id")
    out_of = Window.partitionBy("time_window", "origin_zone_id")
    return flows.withColumns({"in_degree": F.sum("trip_count").over(into), "out_degree": F.sum("trip_count").over(out_of)})
