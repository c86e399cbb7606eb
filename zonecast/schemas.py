"""Declared schemas; jobs never infer one."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """Fields as "name type, ..."; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


RAW_TRIP = _struct(
    "hvfhs_license_num string, pickup_datetime timestamp, dropoff_datetime timestamp, PULocationID int, DOLocationID int, trip_miles double, trip_time double"
)
ZONE = _struct("zone_id int, zone_name string, borough string, centroid_lat double, centroid_lon double")
WEATHER = _struct(
    "observation_time timestamp, station_id string, temperature_c double, precipitation_mm double, wind_speed_ms double, humidity_pct double, weather_condition string"
)


def _zone_role(role: str) -> str:
    return f"{role}_zone_id int, {role}_zone_name string, {role}_borough string, {role}_centroid_lat double, {role}_centroid_lon double"


_TEMPORAL = "hour_of_day int, day_of_week int, is_weekend boolean, is_rush_hour boolean"
ENRICHED_TRIP = T.StructType(
    [
        *RAW_TRIP.fields,
        *_struct("pickup_datetime_nyc string, dropoff_datetime_nyc string").fields,
        *_struct(_zone_role("pu")).fields,
        *_struct(_zone_role("do")).fields,
        *_struct(_TEMPORAL).fields,
    ]
)
TRIP_WEATHER = _struct(
    "weather_temperature_c double, weather_precipitation_mm double, weather_wind_speed_ms double, weather_humidity_pct double, weather_condition string, weather_observation_time timestamp"
)
ENRICHED_TRIP_WEATHER = T.StructType([*ENRICHED_TRIP.fields, *TRIP_WEATHER.fields])

BASELINE = _struct("zone_id int, hour_of_week int, baseline_mean_pickups double")
DEMAND = _struct(
    "time_bucket timestamp, zone_id int, pickup_count int, dropoff_count int, avg_trip_miles double, avg_trip_time double, avg_temperature double, precipitation_mm double"
)
ALERT = _struct("detected_at timestamp, zone_id int, demand_current int, demand_baseline double, ratio double, severity string")
FLOW = _struct("time_window timestamp, origin_zone_id int, dest_zone_id int, trip_count int")
TRIP_EVENT = _struct(
    "pickup_datetime timestamp, dropoff_datetime timestamp, pu_zone_id int, do_zone_id int, trip_miles double, trip_time_min double, " + _TEMPORAL
)
#: What the trip table takes of an enriched trip's message; the other fields are not parsed.
TRIP_MESSAGE = _struct("pickup_datetime_nyc string, dropoff_datetime_nyc string, PULocationID int, DOLocationID int, trip_miles double, trip_time double, " + _TEMPORAL)
FLOW_DEGREES = T.StructType([*FLOW.fields, *_struct("in_degree long, out_degree long").fields])
#: A weather service's answer, as far as it is used.
WEATHER_ANSWER = T.StructType(
    [
        T.StructField("dt", T.LongType()),
        T.StructField("main", _struct("temp double, humidity double")),
        T.StructField("wind", _struct("speed double")),
        T.StructField("rain", _struct("1h double, 3h double")),
        T.StructField("snow", _struct("1h double, 3h double")),
        T.StructField("weather", T.ArrayType(_struct("main string"))),
    ]
)


def as_strings(schema: T.StructType, *names: str) -> T.StructType:
    """The schema with some fields as text, to be parsed by rules of our own."""
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in schema.fields])
