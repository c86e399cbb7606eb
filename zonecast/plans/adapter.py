"""The driver's tables in the roles of trips, zones and weather, for Spark and, word by word the same, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FINE, COARSE = 27, 6
STATION = "KNYC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_trips(events: DataFrame, zones: int = FINE) -> DataFrame:
    """Events as trips: user and props.k give the zones, value the miles and the minutes."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    seconds = F.floor(F.col("value") * 60)
    trip = events.select(
        "event_id",
        F.col("event_type").alias("hvfhs_license_num"),
        F.col("ts").alias("pickup_datetime"),
        (F.col("ts") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("dropoff_datetime"),
        (F.col("user_id") % zones).cast("int").alias("PULocationID"),
        (k % zones).cast("int").alias("DOLocationID"),
        F.col("value").alias("trip_miles"),
        seconds.cast("double").alias("trip_time"),
    )
    return trip


def trips(spark: SparkSession, sf_dir: str, zones: int = FINE) -> DataFrame:
    return as_trips(table(spark, sf_dir, "events"), zones)


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("zone_id"),
        F.col("n_name").alias("zone_name"),
        F.col("r_name").alias("borough"),
        (F.col("n_nationkey") * 1.5).alias("centroid_lat"),
        (F.col("n_nationkey") * 2.5 - 100).alias("centroid_lon"),
    )


def raw_weather(events: DataFrame) -> DataFrame:
    """Every error event as an observation: several in one hour, none in others."""
    return observations(events.where("event_type = 'error'"))


def observations(events: DataFrame) -> DataFrame:
    value = F.col("value")
    return events.select(
        F.col("ts").alias("observation_time"),
        F.concat(F.lit("S"), F.col("event_id").cast("string")).alias("station_id"),
        value.alias("temperature_c"),
        F.when(value > 50, value / 10).alias("precipitation_mm"),
        (value / 2).alias("wind_speed_ms"),
        (value % 7).alias("humidity_pct"),
        F.when(value > 50, "Rain").otherwise("Clear").alias("weather_condition"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_weather(table(spark, sf_dir, "events"))


TRIPS_SQL = """
trips as (
  select event_id, event_type as hvfhs_license_num, ts as pickup_datetime,
         ts + to_seconds(cast(floor(value * 60) as bigint)) as dropoff_datetime,
         cast(user_id % {zones} as integer) as PULocationID,
         cast(cast(json_extract_string(props, '$.k') as bigint) % {zones} as integer) as DOLocationID,
         value as trip_miles, cast(floor(value * 60) as double) as trip_time
  from events)"""
FINE_SQL, COARSE_SQL = TRIPS_SQL.format(zones=FINE), TRIPS_SQL.format(zones=COARSE)
ZONES_SQL = """
zones as (
  select n_nationkey as zone_id, n_name as zone_name, r_name as borough,
         cast(n_nationkey as double) * 1.5 as centroid_lat, cast(n_nationkey as double) * 2.5 - 100 as centroid_lon
  from nation join region on n_regionkey = r_regionkey)"""
WEATHER_SQL = """
weather as (
  select ts as observation_time, 'S' || event_id as station_id, value as temperature_c,
         case when value > 50 then value / 10 end as precipitation_mm, value / 2 as wind_speed_ms,
         value % 7 as humidity_pct, case when value > 50 then 'Rain' else 'Clear' end as weather_condition
  from events where event_type = 'error')"""
HOURLY_WEATHER_SQL = """
hourly as (
  select * exclude (rn) from (
    select *, row_number() over (partition by date_trunc('hour', observation_time) order by observation_time desc, station_id desc) as rn from weather)
  where rn = 1)"""
