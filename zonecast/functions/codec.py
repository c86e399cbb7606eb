"""Rows to keyed JSON messages and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonecast import schemas
from zonecast.functions import temporal


def to_messages(df: DataFrame, key: str, columns: list[str], keep_nulls: bool = True) -> DataFrame:
    """(key, value): the key column as text, the columns as a JSON object; nulls are written unless keep_nulls is off."""
    options = {"ignoreNullFields": "false" if keep_nulls else "true"}
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns), options).alias("value"))


def from_messages(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of each message's JSON value; unknown fields are ignored, missing or malformed ones are null.

    The generator keeps filters on the fields above it: pushed below, each would parse the message once more.
    """
    return messages.select(F.inline(F.array(F.from_json(F.col("value").cast("string"), schema))))


def trip_messages(enriched: DataFrame) -> DataFrame:
    return to_messages(enriched, "PULocationID", schemas.ENRICHED_TRIP.names, keep_nulls=False)


def trip_weather_messages(joined: DataFrame) -> DataFrame:
    return to_messages(joined, "PULocationID", schemas.ENRICHED_TRIP_WEATHER.names)


def demand_messages(demand: DataFrame) -> DataFrame:
    return to_messages(demand, "zone_id", schemas.DEMAND.names)


def alert_messages(alerts: DataFrame) -> DataFrame:
    return to_messages(alerts, "zone_id", schemas.ALERT.names)


def flow_messages(flows: DataFrame) -> DataFrame:
    return to_messages(flows, "origin_zone_id", schemas.FLOW.names)


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all there, judged after parsing: malformed times are gone too."""
    return df.na.drop(subset=list(keys))


def _instants(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: temporal.parse_instant(F.col(n)) for n in names})


def parse_trip_events(messages: DataFrame) -> DataFrame:
    """Messages of enriched trips to rows of the trip table: zone ids renamed, seconds to minutes."""
    read = from_messages(messages, schemas.TRIP_MESSAGE)
    rows = read.select(
        temporal.parse_instant(F.col("pickup_datetime_nyc")).alias("pickup_datetime"),
        temporal.parse_instant(F.col("dropoff_datetime_nyc")).alias("dropoff_datetime"),
        F.col("PULocationID").alias("pu_zone_id"),
        F.col("DOLocationID").alias("do_zone_id"),
        "trip_miles",
        temporal.minutes(F.col("trip_time")).alias("trip_time_min"),
        *schemas.TRIP_EVENT.names[6:],
    )
    return _keyed(rows, "pickup_datetime", "dropoff_datetime", "pu_zone_id", "do_zone_id")


def parse_demand(messages: DataFrame) -> DataFrame:
    rows = from_messages(messages, schemas.as_strings(schemas.DEMAND, "time_bucket"))
    return _keyed(_instants(rows, "time_bucket"), "time_bucket", "zone_id")


def parse_alerts(messages: DataFrame) -> DataFrame:
    rows = from_messages(messages, schemas.as_strings(schemas.ALERT, "detected_at"))
    return _keyed(_instants(rows, "detected_at"), "detected_at", "zone_id")


def parse_flows(messages: DataFrame) -> DataFrame:
    rows = from_messages(messages, schemas.as_strings(schemas.FLOW, "time_window"))
    return _keyed(_instants(rows, "time_window"), "time_window", "origin_zone_id", "dest_zone_id")


def flatten_weather(answers: DataFrame, station: str, value: str = "value") -> DataFrame:
    """JSON answers of a weather service to weather rows: rain and snow add up at one hour, else at three, else null; the time is the hour's start."""
    a = answers.select(F.from_json(F.col(value).cast("string"), schemas.WEATHER_ANSWER).alias("a")).select("a.*")

    def fallen(span: str) -> Column:
        rain, snow = F.col(f"rain.`{span}`"), F.col(f"snow.`{span}`")
        return F.when(rain.isNotNull() | snow.isNotNull(), F.coalesce(rain, F.lit(0.0)) + F.coalesce(snow, F.lit(0.0)))

    return a.select(
        temporal.hour_start(F.timestamp_seconds(F.coalesce("dt", F.lit(0)))).alias("observation_time"),
        F.lit(station).alias("station_id"),
        F.col("main.temp").alias("temperature_c"),
        F.coalesce(fallen("1h"), fallen("3h")).alias("precipitation_mm"),
        F.col("wind.speed").alias("wind_speed_ms"),
        F.col("main.humidity").alias("humidity_pct"),
        F.get("weather", F.lit(0)).getField("main").alias("weather_condition"),
    )
