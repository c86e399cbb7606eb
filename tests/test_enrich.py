"""Calendar features, zones and weather on trips of known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import codec, temporal
from zonecast.operators import checks, enrich
from zonecast.operators.weather import synthetic_weather

ZONES = [(161, "Midtown Center", "Manhattan", 40.75, -73.97), (162, "Midtown East", "Manhattan", 40.75, -73.96), (236, "Upper East South", "Manhattan", 40.78, -73.95)]


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame(ZONES, schemas.ZONE)


def trips(spark, *rows):
    """(pickup, dropoff, from, to[, miles, seconds]) with times as text of the session's zone."""
    full = [("HV0003", *r, *((2.5, 600.0) if len(r) == 4 else ())) for r in rows]
    made = spark.createDataFrame(full, "hvfhs_license_num string, p string, d string, PULocationID int, DOLocationID int, trip_miles double, trip_time double")
    return made.select(
        "hvfhs_license_num", F.to_timestamp("p").alias("pickup_datetime"), F.to_timestamp("d").alias("dropoff_datetime"), "PULocationID", "DOLocationID", "trip_miles", "trip_time"
    )


@pytest.mark.parametrize(
    ("at", "hour", "day", "weekend", "rush"),
    [
        ("2024-07-15 14:30:00", 14, 2, False, False),
        ("2024-07-14 08:00:00", 8, 1, True, False),
        ("2024-07-13 08:00:00", 8, 7, True, False),
        ("2024-07-12 12:00:00", 12, 6, False, False),
        ("2024-07-15 07:00:00", 7, 2, False, True),
        ("2024-07-15 09:59:00", 9, 2, False, True),
        ("2024-07-15 10:00:00", 10, 2, False, False),
        ("2024-07-15 16:00:00", 16, 2, False, True),
        ("2024-07-15 19:59:00", 19, 2, False, True),
        ("2024-07-15 20:00:00", 20, 2, False, False),
        ("2024-03-10 03:30:00", 3, 1, True, False),
        ("2024-11-03 01:30:00", 1, 1, True, False),
    ],
)
def test_calendar(spark, zones, at, hour, day, weekend, rush):
    row = enrich.enrich_trips(trips(spark, (at, None, 161, 236)), zones).first()
    assert (row.hour_of_day, row.day_of_week, row.is_weekend, row.is_rush_hour) == (hour, day, weekend, rush)
    assert row.pickup_datetime_nyc == at and row.dropoff_datetime_nyc is None


def test_zones(spark, zones):
    rows = trips(spark, ("2024-07-15 14:30:00", None, 161, 236), ("2024-07-15 14:31:00", None, 999, None), (None, None, 161, 161), ("2024-07-15 14:32:00", None, None, 161))
    found = enrich.enrich_trips(rows, zones).orderBy("pickup_datetime").collect()
    assert [(r.pu_zone_name, r.do_zone_name) for r in found] == [("Midtown Center", "Upper East South"), (None, None)]
    assert list(found[0].asDict()) == schemas.ENRICHED_TRIP.names and len(schemas.ENRICHED_TRIP.names) == 23
    assert checks.unknown_zones(rows, zones, "PULocationID").count() == 1


@pytest.mark.parametrize(("at", "want"), [("2024-07-15 14:30:00", 14), ("2024-07-14 09:00:00", 153), ("2024-07-14 23:59:59", 167), ("2024-07-15 00:00:00", 0)])
def test_hour_of_week(spark, at, want):
    assert spark.range(1).select(temporal.hour_of_week(F.to_timestamp(F.lit(at)))).first()[0] == want


def weather(spark, *rows):
    full = [(t, "KNYC", c, mm, 3.0, 60.0, "Rain" if mm else "Clear") for t, c, mm in rows]
    made = spark.createDataFrame(full, schemas.as_strings(schemas.WEATHER, "observation_time"))
    return made.withColumn("observation_time", temporal.parse_instant(F.col("observation_time")))


@pytest.mark.parametrize(
    ("observed", "want"),
    [("2026-07-15T18:30:00Z", 22.5), ("2026-07-15T18:00:00+00:00", 22.5), ("2026-07-15T14:45:00.000-04:00", 22.5), ("2026-07-15T15:00:00Z", None), (None, None)],
)
def test_weather(spark, zones, observed, want):
    told = enrich.enrich_trips(trips(spark, ("2026-07-15 14:00:00", None, 161, 236)), zones)
    rows = enrich.join_weather(told, weather(spark, (observed, 22.5, 2.5))).collect()
    assert len(rows) == 1 and rows[0].weather_temperature_c == want
    message = json.loads(codec.trip_weather_messages(enrich.join_weather(told, weather(spark, (observed, 22.5, 2.5)))).first().value)
    assert list(message) == schemas.ENRICHED_TRIP_WEATHER.names and len(message) == 29 and message["dropoff_datetime"] is None


def test_weather_of_one_hour_does_not_repeat_trips(spark, zones):
    told = enrich.enrich_trips(trips(spark, ("2026-07-15 14:00:00", None, 161, 236)), zones)
    seen = weather(spark, ("2026-07-15T18:10:00Z", 20.0, None), ("2026-07-15T18:50:00Z", 21.0, 0.5))
    assert enrich.join_weather(told, seen).count() == 2
    assert [r.weather_temperature_c for r in enrich.join_weather(told, enrich.hourly_weather(seen)).collect()] == [21.0]


def test_trip_messages(spark, zones):
    message = codec.trip_messages(enrich.enrich_trips(trips(spark, ("2024-07-15 14:30:00", None, 161, 999)), zones)).first()
    value = json.loads(message.value)
    assert message.key == "161" and value["pickup_datetime_nyc"] == "2024-07-15 14:30:00" and "do_zone_name" not in value


def test_months(spark):
    months = [r[0].strftime("%Y-%m") for r in temporal.month_series(spark, "2024-11", "2025-02").orderBy("month").collect()]
    assert months == ["2024-11", "2024-12", "2025-01", "2025-02"]
    assert spark.range(1).select(temporal.published_month(F.lit("2025-02-14").cast("date")).cast("string")).first()[0] == "2024-12-01"
    name = spark.createDataFrame([("/x/fhvhv_tripdata_2024-07.parquet",), ("other.parquet",)], "n string")
    assert [r[0] for r in name.select(temporal.file_month(F.col("n")).cast("string")).collect()] == ["2024-07-01", None]
    assert checks.month_of_file("a/fhvhv_tripdata_2024-07.parquet") == "2024-07" and checks.month_of_file("b") is None


def test_weather_answers(spark):
    answers = [
        '{"dt": 1720000123, "main": {"temp": 22.5, "humidity": 60}, "wind": {"speed": 3.4}, "weather": [{"main": "Clouds"}], "rain": {"1h": 0.5}}',
        '{"dt": 1720000123, "rain": {"3h": 1.0}, "snow": {"1h": 0.25}}',
        '{"dt": 0, "weather": [], "snow": {"3h": 2.0}}',
        "not json",
    ]
    rows = codec.flatten_weather(spark.createDataFrame([(a,) for a in answers], "value string"), "KNYC").collect()
    assert (rows[0].temperature_c, rows[0].humidity_pct, rows[0].wind_speed_ms, rows[0].weather_condition, rows[0].precipitation_mm) == (22.5, 60.0, 3.4, "Clouds", 0.5)
    assert [r.precipitation_mm for r in rows[1:]] == [0.25, 2.0, None] and rows[2].weather_condition is None
    assert rows[0].observation_time.minute == 0 and rows[0].observation_time.second == 0


def test_synthetic_weather(spark):
    made = synthetic_weather(spark, "2024-01-01T00:00:00Z", 96)
    rows = made.orderBy("observation_time").collect()
    assert len(rows) == 96 and made.columns == schemas.WEATHER.names
    assert all((b.observation_time - a.observation_time).total_seconds() == 3600 for a, b in zip(rows, rows[1:], strict=False))
    assert all(-10 <= r.temperature_c <= 40 and 0 <= r.humidity_pct <= 100 and 3 <= r.wind_speed_ms <= 8 for r in rows)
    assert all((r.precipitation_mm is not None) == (r.weather_condition == "Rain") for r in rows)
    assert rows == synthetic_weather(spark, "2024-01-01T00:00:00Z", 96).repartition(5).orderBy("observation_time").collect()
    assert rows != synthetic_weather(spark, "2024-01-01T00:00:00Z", 96, seed=1).orderBy("observation_time").collect()


def test_zone_table(spark):
    lookup = spark.createDataFrame([(1, "A", "X"), (264, "Unknown", "Y")], "locationid int, ZONE string, borough string")
    places = spark.createDataFrame([(1, 1.0, 2.0)], "Zone_ID int, Latitude double, lng double")
    assert [tuple(r) for r in checks.zone_table(lookup, places).collect()] == [(1, "A", "X", 1.0, 2.0)]
    with pytest.raises(KeyError):
        checks.zone_table(lookup.drop("ZONE"), places)


def test_fan_out_keeps_its_partitions(spark):
    """All rows of the plain join, trips of no hour or no weather too; hours stay dealt over several tasks, however little goes in."""
    trips = spark.sql("select id as event_id, if(id % 7 = 0, null, timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, id % 4)) as pickup_datetime from range(40)").coalesce(1)
    weather = spark.sql(
        """select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id % 3, id % 50) as observation_time, double(id * 7 % 5) as temperature_c, 0d as precipitation_mm,
        1d as wind_speed_ms, 2d as humidity_pct, 'Clear' as weather_condition from range(60)"""
    ).repartition(5)
    found, plain = enrich.fan_out_weather(trips, weather).collect(), enrich.join_weather(trips, weather).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, plain)) and len(found) > 400
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert tasks(enrich.fan_out_weather(trips, weather)) > 1 == tasks(enrich.join_weather(trips, weather))


def test_fan_out_tells_observations_once(spark):
    """What is made of an observation is made before the join, whatever comes out; the observations of an hour come in one order, like ones together."""
    trips = spark.sql("select id as event_id, timestamp'2024-01-01 00:30:00' as pickup_datetime from range(100)").repartition(3)
    weather = spark.sql(
        """select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id % 5) as observation_time, double(id % 5) as temperature_c, 0d as precipitation_mm,
        1d as wind_speed_ms, 2d as humidity_pct, if(id % 2 = 0, 'Clear', 'Rain') as weather_condition from range(40)"""
    ).repartition(5)
    made = spark.sparkContext.accumulator(0)

    def stamped(t):
        made.add(1)
        return str(t)

    told = lambda df: df.withColumn("weather_observation_time", F.udf(stamped)("weather_observation_time"))
    rows = enrich.fan_out_weather(trips, weather, told).collect()
    assert made.value == 40 and len(rows) == 4000
    assert sorted(map(repr, rows)) == sorted(map(repr, told(enrich.join_weather(trips, weather)).collect()))
    seen = {}
    for r in rows:
        seen.setdefault(r.event_id, []).append((r.weather_condition, r.weather_observation_time, r.weather_temperature_c))
    assert all(x == sorted(x) for x in seen.values())
