"""Trips with calendar features, zone context and weather."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from zonecast import schemas
from zonecast.functions import temporal

#: Catalyst's estimate up to which a dimension is broadcast by hint; a larger one is left to the planner.
BROADCAST_BYTES = 64 << 20
#: Bytes of rows, about, that are put together into blocks at a time.
BLOCK_BYTES = 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint where its estimated size is within the limit."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def located_trips(trips: DataFrame) -> DataFrame:
    """Trips with pickup time and pickup zone; dropoff fields may be null."""
    return trips.na.drop(subset=["pickup_datetime", "PULocationID"])


def add_calendar(trips: DataFrame) -> DataFrame:
    start = F.col("pickup_datetime")
    return trips.withColumns(
        {
            "hour_of_day": temporal.hour_of_day(start),
            "day_of_week": temporal.day_of_week(start),
            "is_weekend": temporal.is_weekend(start),
            "is_rush_hour": temporal.is_rush_hour(start),
            "pickup_datetime_nyc": temporal.wall_clock(start),
            "dropoff_datetime_nyc": temporal.wall_clock(F.col("dropoff_datetime")),
        }
    )


def zone_role(zones: DataFrame, role: str) -> DataFrame:
    """The zone table in one role: every column under the role's prefix."""
    return zones.select(*(F.col(c).alias(f"{role}_{c}") for c in schemas.ZONE.names))


def add_zone(trips: DataFrame, zones: DataFrame, role: str, key: str) -> DataFrame:
    """Trips with the zone of a key column; trips of unknown zones stay, with nulls."""
    lookup = small(zone_role(zones, role))
    return trips.join(lookup, F.col(key) == F.col(f"{role}_zone_id"), "left")


def enrich_trips(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Raw trips to the enriched columns, in their declared order."""
    told = add_calendar(located_trips(trips))
    placed = add_zone(add_zone(told, zones, "pu", "PULocationID"), zones, "do", "DOLocationID")
    return placed.select(*schemas.ENRICHED_TRIP.names)


def hourly_weather(weather: DataFrame) -> DataFrame:
    """One observation for each hour: the latest, then the least station; a second one would repeat every trip of the hour."""
    hour = temporal.hour_start(F.col("observation_time"))
    rest = [c for c in weather.columns if c != "observation_time"]
    order = F.struct(F.col("observation_time"), *(F.col(c) for c in rest))
    latest = weather.where("observation_time is not null").groupBy(hour.alias("_hour")).agg(
        F.max(F.col("observation_time")).alias("_latest"), F.max_by(F.struct(*weather.columns), order).alias("_o")
    )
    return latest.select("_o.*")


def _by_hour(trips: DataFrame, weather: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the hour that they join on, weather under the names that it has beside a trip."""
    left = trips.withColumn("_trip_hour", temporal.hour_start(F.col("pickup_datetime")))
    right = weather.select(
        temporal.hour_start(F.col("observation_time")).alias("_weather_hour"),
        F.col("temperature_c").alias("weather_temperature_c"),
        F.col("precipitation_mm").alias("weather_precipitation_mm"),
        F.col("wind_speed_ms").alias("weather_wind_speed_ms"),
        F.col("humidity_pct").alias("weather_humidity_pct"),
        "weather_condition",
        F.col("observation_time").alias("weather_observation_time"),
    )
    return left, right


def join_weather(trips: DataFrame, weather: DataFrame, trip_delay: str | None = None, weather_delay: str | None = None) -> DataFrame:
    """Every trip with the weather of its pickup's hour, nulls where there is none.

    With delays, both sides are watermarked on the hour that they join on, as an outer join of streams needs. Weather of
    several observations in one hour repeats the trip: see hourly_weather.
    """
    left, right = _by_hour(trips, weather)
    if trip_delay is not None:
        left = left.withWatermark("_trip_hour", trip_delay)
    if weather_delay is not None:
        right = right.withWatermark("_weather_hour", weather_delay)
    return left.join(right, F.col("_trip_hour") == F.col("_weather_hour"), "left").drop("_trip_hour", "_weather_hour")


def fan_out_weather(trips: DataFrame, weather: DataFrame, told: Callable[[DataFrame], DataFrame] = lambda observed: observed) -> DataFrame:
    """The rows of join_weather, of tables only, where hours hold many observations and far more comes out than goes in.

    Partitions are not joined to fewer by the bytes that go in. told: what is made of the weather's columns, once for each
    observation and not for each row that comes out. Trips meet the observations of their hour in one order, with like ones
    beside each other, so that files of what comes out hold runs.
    """
    left, right = _by_hour(trips, weather)
    width = int(trips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hour, *rest = told(right).columns
    like = Window.partitionBy(hour).orderBy("weather_condition", *(c for c in rest if c != "weather_condition"))
    # Catalyst removes a mere sort below a join, and a number that nothing reads; the merge needs no other order than this.
    dealt = told(right).repartition(width, hour).withColumn("_n", F.row_number().over(like)).where("_n > 0").drop("_n").hint("merge")
    return left.join(dealt, F.col("_trip_hour") == F.col("_weather_hour"), "left").drop("_trip_hour", "_weather_hour")


def _in_blocks(rows: DataFrame, hour: str, name: str) -> DataFrame:
    """(hour, array of rows): rows of one hour that stand near each other in a partition are a block; of tables and streams alike, without state."""
    least = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            table = table.take(table.select([hour]).append_column("_n", pa.array(np.arange(len(table)))).sort_by([(hour, "ascending"), ("_n", "ascending")]).column("_n"))
            hours = table.column(hour).combine_chunks()
            keys = hours.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            columns = {c: table.column(c).combine_chunks() for c in table.column_names if c != hour}
            struct = pa.StructArray.from_arrays(list(columns.values()), fields=[pa.field(c, x.type) for c, x in columns.items()])
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(table)], pa.int32()), struct)
            return pa.RecordBatch.from_arrays([hours.take(pa.array(starts)), lists], names=[hour, name])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= least:
                yield blocks()
                held, size = [], 0
        if held:
            yield blocks()

    one = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name != hour])
    return rows.mapInArrow(run, StructType([StructField(hour, rows.schema[hour].dataType), StructField(name, ArrayType(one))]))


def pair_weather(trips: DataFrame, weather: DataFrame, trip_delay: str | None = None, weather_delay: str | None = None) -> DataFrame:
    """The rows of join_weather as pairs of blocks (_trips, _observed), where far more comes out than goes in: see unfold_weather.

    All rows of a block have one hour, which is all that the join, the watermarks and the lateness of a row look at, so blocks
    fare as their rows do.
    """
    left, right = (_in_blocks(rows, hour, name) for rows, hour, name in zip(_by_hour(trips, weather), ("_trip_hour", "_weather_hour"), ("_trips", "_observed"), strict=True))
    if trip_delay is not None:
        left = left.withWatermark("_trip_hour", trip_delay)
    if weather_delay is not None:
        right = right.withWatermark("_weather_hour", weather_delay)
    return left.join(right, F.col("_trip_hour") == F.col("_weather_hour"), "left").select("_trips", "_observed")


def unfold_weather(pairs: DataFrame) -> DataFrame:
    """A row for each trip and observation of each pair of blocks; trips of a block without observations stay, with nulls."""
    told = pairs.select(F.explode("_trips").alias("_trip"), "_observed").select("_trip", F.explode_outer("_observed").alias("_seen"))
    return told.select("_trip.*", "_seen.*")


def unfold_kept_weather(pairs: DataFrame, *key: str) -> DataFrame:
    """The rows of unfold_weather, of pairs that stand in a table and have a key of their own.

    Nested explodes hold all rows of a pair at once. Here both blocks become rows that are merged by the key, so a task
    holds one block's observations, and partitions are not joined to fewer by the bytes that go in.
    """
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trips, seen = (pairs.select(*key, F.explode(c).alias("_one")).select(*key, "_one.*").repartition(width, *key) for c in ("_trips", "_observed"))
    seen = seen.withColumnsRenamed({k: f"_of{k}" for k in key})
    same = reduce(and_, (F.col(k) == F.col(f"_of{k}") for k in key))
    return trips.join(seen.hint("merge"), same, "left").drop(*key, *(f"_of{k}" for k in key))
