"""The queries by name, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import codec, temporal
from zonecast.operators import baseline as base
from zonecast.operators import checks, demand, enrich, flows
from zonecast.operators.weather import synthetic_weather
from zonecast.plans import adapter as a
from zonecast.session import scratch_folder
from zonecast.sources import readers, tables
from zonecast.streaming import jobs, replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

STAMP_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def stamp(name: str) -> Column:
    return temporal.wall_clock(F.col(name)).alias(name)


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


# Enrichment

CALENDAR_SQL = """
  cast(hour(pickup_datetime) as smallint) as hour_of_day, cast(dayofweek(pickup_datetime) + 1 as smallint) as day_of_week,
  isodow(pickup_datetime) >= 6 as is_weekend,
  isodow(pickup_datetime) < 6 and (hour(pickup_datetime) between 7 and 9 or hour(pickup_datetime) between 16 and 19) as is_rush_hour,
  strftime(pickup_datetime, '%Y-%m-%d %H:%M:%S') as pickup_datetime_nyc, strftime(dropoff_datetime, '%Y-%m-%d %H:%M:%S') as dropoff_datetime_nyc"""


@query(f"with {a.FINE_SQL} select event_id, {CALENDAR_SQL}, cast((isodow(pickup_datetime) - 1) * 24 + hour(pickup_datetime) as integer) as hour_of_week from trips")
def trip_temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = enrich.add_calendar(enrich.located_trips(a.trips(spark, sf_dir)))
    names = ("hour_of_day", "day_of_week", "is_weekend", "is_rush_hour", "pickup_datetime_nyc", "dropoff_datetime_nyc")
    return told.select("event_id", *names, temporal.hour_of_week(F.col("pickup_datetime")).alias("hour_of_week"))


ENRICHED_SQL = f"""
enriched as (
  select trips.*, {CALENDAR_SQL},
    p.zone_id as pu_zone_id, p.zone_name as pu_zone_name, p.borough as pu_borough, p.centroid_lat as pu_centroid_lat, p.centroid_lon as pu_centroid_lon,
    d.zone_id as do_zone_id, d.zone_name as do_zone_name, d.borough as do_borough, d.centroid_lat as do_centroid_lat, d.centroid_lon as do_centroid_lon
  from trips left join zones p on PULocationID = p.zone_id left join zones d on DOLocationID = d.zone_id
  where pickup_datetime is not null and PULocationID is not null)"""
ENRICHED_NAMES = schemas.ENRICHED_TRIP.names
ENRICHED_OUT_SQL = ", ".join(f"{STAMP_SQL.format(c)} as {c}" if c in ("pickup_datetime", "dropoff_datetime") else c for c in ENRICHED_NAMES)


def _enriched(spark: SparkSession, sf_dir: str, zones: int = a.FINE) -> DataFrame:
    return enrich.enrich_trips(a.trips(spark, sf_dir, zones), a.zones(spark, sf_dir))


def _stamped(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: temporal.wall_clock(F.col(n)) for n in names})


@query(f"with {a.FINE_SQL}, {a.ZONES_SQL}, {ENRICHED_SQL} select {ENRICHED_OUT_SQL} from enriched")
def trip_zone_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(_enriched(spark, sf_dir), "pickup_datetime", "dropoff_datetime")


WEATHER_OUT_SQL = f"""w.temperature_c as weather_temperature_c, w.precipitation_mm as weather_precipitation_mm, w.wind_speed_ms as weather_wind_speed_ms,
  w.humidity_pct as weather_humidity_pct, w.weather_condition, {STAMP_SQL.format('w.observation_time')} as weather_observation_time"""
WEATHER_JOIN_SQL = f"""with {a.FINE_SQL}, {a.WEATHER_SQL}, {a.HOURLY_WEATHER_SQL}
select event_id, {WEATHER_OUT_SQL} from trips left join {{}} w on date_trunc('hour', pickup_datetime) = date_trunc('hour', observation_time)"""


def _weather_out(joined: DataFrame) -> DataFrame:
    return _stamped(joined.select("event_id", *schemas.TRIP_WEATHER.names), "weather_observation_time")


@query(WEATHER_JOIN_SQL.format("hourly"))
def trip_weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weather_out(enrich.join_weather(a.trips(spark, sf_dir), enrich.hourly_weather(a.weather(spark, sf_dir))))


@query(WEATHER_JOIN_SQL.format("weather"))
def weather_fanout_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times are written out once for each observation, before the join."""
    trips = a.trips(spark, sf_dir).select("event_id", "pickup_datetime")
    joined = enrich.fan_out_weather(trips, a.weather(spark, sf_dir), lambda observed: _stamped(observed, "weather_observation_time"))
    return joined.select("event_id", *schemas.TRIP_WEATHER.names)


# Demand

DEMAND_CTE = """
joined as (
  select trips.*, w.temperature_c, w.precipitation_mm from trips left join hourly w on date_trunc('hour', pickup_datetime) = date_trunc('hour', observation_time)),
picked as (
  select time_bucket(interval '15 minutes', pickup_datetime) as time_bucket, PULocationID as zone_id, count(*) as pickup_count, avg(trip_miles) as avg_trip_miles,
         avg(trip_time / 60.0) as avg_trip_time, avg(temperature_c) as avg_temperature, avg(precipitation_mm) as precipitation_mm
  from joined where pickup_datetime is not null and PULocationID is not null group by 1, 2),
dropped as (
  select time_bucket(interval '15 minutes', dropoff_datetime) as time_bucket, DOLocationID as zone_id, count(*) as dropoff_count
  from joined where dropoff_datetime is not null and DOLocationID is not null group by 1, 2),
demand as (select * from picked {join} join dropped using (time_bucket, zone_id))"""
DEMAND_OUT_SQL = f"""select {STAMP_SQL.format('time_bucket')} as time_bucket, zone_id, cast(coalesce(pickup_count, 0) as integer) as pickup_count,
  cast(coalesce(dropoff_count, 0) as integer) as dropoff_count, round(avg_trip_miles, 6) as avg_trip_miles, round(avg_trip_time, 6) as avg_trip_time,
  round(avg_temperature, 6) as avg_temperature, round(precipitation_mm, 6) as precipitation_mm"""


def demand_sql(trips: str, join: str) -> str:
    return f"with {trips}, {a.WEATHER_SQL}, {a.HOURLY_WEATHER_SQL}, {DEMAND_CTE.format(join=join)}"


def _demand(spark: SparkSession, sf_dir: str, mode: str, zones: int = a.FINE) -> DataFrame:
    joined = enrich.join_weather(a.trips(spark, sf_dir, zones), enrich.hourly_weather(a.weather(spark, sf_dir)))
    return demand.zone_demand(joined, mode=mode)


def _demand_out(df: DataFrame) -> DataFrame:
    return df.select(
        stamp("time_bucket"), "zone_id", "pickup_count", "dropoff_count", *(rounded(c) for c in ("avg_trip_miles", "avg_trip_time", "avg_temperature", "precipitation_mm"))
    )


@query(demand_sql(a.FINE_SQL, "inner") + DEMAND_OUT_SQL + " from demand")
def demand_15min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand_out(_demand(spark, sf_dir, "both_sides"))


@query(demand_sql(a.FINE_SQL, "full") + DEMAND_OUT_SQL + " from demand")
def demand_15min_either_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand_out(_demand(spark, sf_dir, "either_side"))


# Baseline

BASELINE_CTE = """
weeks as (select min(date_trunc('week', pickup_datetime)) as lo, max(date_trunc('week', pickup_datetime)) as hi, count(distinct date_trunc('week', pickup_datetime)) - 2 as n from trips),
counts as (
  select PULocationID as zone_id, cast((isodow(pickup_datetime) - 1) * 24 + hour(pickup_datetime) as integer) as hour_of_week, count(*) as pickups
  from trips, weeks where date_trunc('week', pickup_datetime) > lo and date_trunc('week', pickup_datetime) < hi and PULocationID is not null group by 1, 2),
grid as (select cast(z.range as integer) as zone_id, cast(h.range as integer) as hour_of_week from range({zones}) z, range(168) h),
baseline as (
  select zone_id, hour_of_week, coalesce(pickups, 0) / cast(n as double) as baseline_mean_pickups
  from grid left join counts using (zone_id, hour_of_week), weeks)"""


def _baseline(spark: SparkSession, sf_dir: str, zones: int) -> DataFrame:
    kept, weeks = base.complete_weeks(a.trips(spark, sf_dir, zones))
    ids = spark.range(zones).select(F.col("id").cast("int").alias("zone_id"))
    return base.zone_baseline(spark, kept, weeks, ids)


@query(f"with {a.FINE_SQL}, {BASELINE_CTE.format(zones=a.FINE)} select zone_id, hour_of_week, pickups from counts")
def zone_hour_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.zone_hour_counts(base.complete_weeks(a.trips(spark, sf_dir))[0])


@query(f"with {a.FINE_SQL}, {BASELINE_CTE.format(zones=a.FINE)} select zone_id, hour_of_week, round(baseline_mean_pickups, 6) as baseline_mean_pickups from baseline")
def zone_hour_baseline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baseline(spark, sf_dir, a.FINE).select("zone_id", "hour_of_week", rounded("baseline_mean_pickups"))


@query(
    f"""with {a.COARSE_SQL}, {BASELINE_CTE.format(zones=a.COARSE)} select count(*) as cells, count(distinct zone_id) as zones, count(distinct hour_of_week) as hours,
round(min(baseline_mean_pickups), 6) as least, round(max(baseline_mean_pickups), 6) as greatest, round(avg(baseline_mean_pickups), 6) as mean,
round(quantile_cont(baseline_mean_pickups, 0.5), 6) as p50, round(quantile_cont(baseline_mean_pickups, 0.9), 6) as p90, round(quantile_cont(baseline_mean_pickups, 0.99), 6) as p99,
count(*) filter (baseline_mean_pickups < 1.0) as low_cells, round(100.0 * (count(*) filter (baseline_mean_pickups < 1.0)) / count(*), 6) as low_percent from baseline"""
)
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = base.summary(_baseline(spark, sf_dir, a.COARSE))
    counts = ("cells", "zones", "hours", "low_cells")
    return found.select(*(c if c in counts else rounded(c) for c in found.columns))


RANKED_SQL = f"with {a.COARSE_SQL}, {BASELINE_CTE.format(zones=a.COARSE)} select zone_id, round(avg(baseline_mean_pickups), 6) as mean_pickups from baseline group by 1 order by avg(baseline_mean_pickups) {{}}, zone_id limit 5"


@query(RANKED_SQL.format("desc"))
def baseline_top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.ranked_zones(_baseline(spark, sf_dir, a.COARSE)).select("zone_id", rounded("mean_pickups"))


@query(RANKED_SQL.format("asc"))
def baseline_bottom_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.ranked_zones(_baseline(spark, sf_dir, a.COARSE), busiest=False).select("zone_id", rounded("mean_pickups"))


RATED_SQL = f"""{demand_sql(a.COARSE_SQL, 'inner')}, {BASELINE_CTE.format(zones=a.COARSE)},
rated as (
  select demand.*, baseline_mean_pickups, baseline_mean_pickups * 0.25 as demand_baseline,
         case when baseline_mean_pickups > 0 then pickup_count / (baseline_mean_pickups * 0.25) end as ratio
  from demand left join baseline b on demand.zone_id = b.zone_id and (isodow(time_bucket) - 1) * 24 + hour(time_bucket) = b.hour_of_week)"""


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.attach_baseline(_demand(spark, sf_dir, "both_sides", a.COARSE), _baseline(spark, sf_dir, a.COARSE))


@query(
    f"{RATED_SQL} select {STAMP_SQL.format('time_bucket')} as time_bucket, zone_id, cast(pickup_count as integer) as pickup_count, round(baseline_mean_pickups, 6) as baseline_mean_pickups, round(demand_baseline, 6) as demand_baseline, round(ratio, 6) as ratio from rated"
)
def demand_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("baseline_mean_pickups", "demand_baseline", "ratio")
    return _rated(spark, sf_dir).select(stamp("time_bucket"), "zone_id", "pickup_count", *(rounded(c) for c in names))


@query(
    f"{RATED_SQL} select {STAMP_SQL.format('time_bucket')} as detected_at, zone_id, cast(pickup_count as integer) as demand_current, round(demand_baseline, 6) as demand_baseline, round(ratio, 6) as ratio, case when ratio >= 3 then 'critical' else 'warning' end as severity from rated where demand_baseline >= 1 and ratio >= 2"
)
def hotspot_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.hotspots(_rated(spark, sf_dir)).select(stamp("detected_at"), "zone_id", "demand_current", rounded("demand_baseline"), rounded("ratio"), "severity")


# Flows

FLOW_CTE = """
flows as (
  select date_trunc('hour', pickup_datetime) as time_window, PULocationID as origin_zone_id, DOLocationID as dest_zone_id, cast(count(*) as integer) as trip_count
  from trips where pickup_datetime is not null and PULocationID is not null and DOLocationID is not null group by 1, 2, 3)"""
FLOW_OUT_SQL = f"{STAMP_SQL.format('time_window')} as time_window, origin_zone_id, dest_zone_id, trip_count"
DEGREE_OUT_SQL = f"{FLOW_OUT_SQL}, cast(sum(trip_count) over (partition by time_window, dest_zone_id) as bigint) as in_degree, cast(sum(trip_count) over (partition by time_window, origin_zone_id) as bigint) as out_degree"


@query(f"with {a.FINE_SQL}, {FLOW_CTE} select {FLOW_OUT_SQL} from flows")
def od_flow_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(flows.od_flows(a.trips(spark, sf_dir)), "time_window")


@query(f"with {a.FINE_SQL}, {FLOW_CTE} select {DEGREE_OUT_SQL} from flows")
def od_flow_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(flows.with_degrees(flows.od_flows(a.trips(spark, sf_dir))), "time_window")


# Checks

NULLED = {"pickup_datetime": 11, "PULocationID": 13, "DOLocationID": 29}
NULLED_SQL = ", ".join(f"case when event_id % {n} <> 0 then {c} end as {c}" for c, n in NULLED.items())


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = a.trips(spark, sf_dir)
    return trips.withColumns({c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in NULLED.items()})


@query(
    f"with {a.FINE_SQL}, holed as (select {NULLED_SQL} from trips) "
    + " union all ".join(f"select '{c}' as column_name, round(avg(cast({c} is null as integer)), 6) as null_fraction, avg(cast({c} is null as integer)) <= 0.05 as ok from holed" for c in NULLED)
)
def quality_null_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.null_fractions(_with_nulls(spark, sf_dir)).select("column_name", rounded("null_fraction"), "ok")


@query(
    f"with {a.FINE_SQL} "
    + " union all ".join(f"select '{c}' as column_name, min({c}) as least, max({c}) as greatest, min({c}) >= 1 and max({c}) <= 265 as ok from trips" for c in ("PULocationID", "DOLocationID"))
)
def quality_zone_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.zone_ranges(a.trips(spark, sf_dir))


@query(
    f"with {a.FINE_SQL} select {STAMP_SQL.format('min(pickup_datetime)')} as first_pickup, {STAMP_SQL.format('max(pickup_datetime)')} as last_pickup, strftime(min(pickup_datetime), '%Y-%m') = '2024-01' and strftime(max(pickup_datetime), '%Y-%m') = '2024-01' as ok from trips"
)
def quality_month_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(checks.month_range(a.trips(spark, sf_dir), "2024-01"), "first_pickup", "last_pickup")


@query(
    f"with {a.FINE_SQL}, holed as (select {NULLED_SQL} from trips), c as (select count(*) as raw_rows, count(*) filter (pickup_datetime is not null and PULocationID is not null) as clean_rows from holed) select raw_rows, clean_rows, round(1 - clean_rows / raw_rows, 6) as dropped_fraction from c"
)
def quality_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.row_counts(_with_nulls(spark, sf_dir)).select("raw_rows", "clean_rows", rounded("dropped_fraction"))


@query(
    f"""with {a.FINE_SQL}, c as (select count(*) as n, min(PULocationID) >= 1 and max(PULocationID) <= 265 as pu, min(DOLocationID) >= 1 and max(DOLocationID) <= 265 as d,
strftime(min(pickup_datetime), '%Y-%m') = '2024-01' and strftime(max(pickup_datetime), '%Y-%m') = '2024-01' as m from trips)
select n as "rows", n >= 5000000 as enough, pu as zones_pu, d as zones_do, m as in_month, n >= 5000000 and pu and d and m as passed from c"""
)
def trip_file_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.validate_trips(a.trips(spark, sf_dir).drop("event_id"), "2024-01")
    names = {"row_count": "enough", "zones PULocationID": "zones_pu", "zones DOLocationID": "zones_do", "month": "in_month"}
    return found.select("rows", *(F.col("checks")[k].alias(v) for k, v in names.items()), "passed")


@query(f"with {a.FINE_SQL}, {a.ZONES_SQL} select event_id, PULocationID from trips where PULocationID is not null and PULocationID not in (select zone_id from zones)")
def unknown_zone_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unknown_zones(a.trips(spark, sf_dir), a.zones(spark, sf_dir), "PULocationID").select("event_id", "PULocationID")


@query(
    f"with {a.ZONES_SQL} select cast(s.s_nationkey as integer) as zone_id, s.s_name as zone_name, z.borough, z.centroid_lat, z.centroid_lon from supplier s join zones z on s.s_nationkey = z.zone_id"
)
def zone_table_from_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, zones = a.table(spark, sf_dir, "supplier"), a.zones(spark, sf_dir)
    named = supplier.join(zones, F.col("s_nationkey") == F.col("zone_id")).select(F.col("s_nationkey").alias("locationid"), F.col("s_name").alias("ZONE"), "borough")
    places = zones.select(F.col("zone_id").alias("Location_ID"), F.col("centroid_lat").alias("Latitude"), F.col("centroid_lon").alias("LNG"))
    return checks.zone_table(named, places)


# Time

@query(
    "select event_id, user_id, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) / 1e6 / 100, 6) as gap_seconds from events"
)
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = a.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return tables.gaps(events, "ts", "event_id", speed=100.0, by=("user_id",)).select("event_id", "user_id", rounded("gap_seconds"))


@query("select event_id, round(coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (order by ts, event_id), 0) / 1e6, 6) as gap_seconds from events")
def replay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = a.table(spark, sf_dir, "events").select("event_id", "ts")
    return tables.gaps(events, "ts", "event_id").select("event_id", rounded("gap_seconds"))


@query(
    "select strftime(m, '%Y-%m') as \"month\" from (select unnest(generate_series(date '1992-01-01', date '1999-12-01', interval 1 month)) as m) where m not in (select date_trunc('month', o_orderdate) from orders)"
)
def month_gap_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = a.table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month")).distinct()
    return temporal.missing_months(temporal.month_series(spark, "1992-01", "1999-12"), present).select(F.date_format("month", "yyyy-MM").alias("month"))


# Messages

@query(
    f"with {a.FINE_SQL}, {a.ZONES_SQL}, {ENRICHED_SQL} select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, {STAMP_SQL.format('dropoff_datetime')} as dropoff_datetime, PULocationID as pu_zone_id, DOLocationID as do_zone_id, trip_miles, trip_time / 60.0 as trip_time_min, cast(hour_of_day as integer) as hour_of_day, cast(day_of_week as integer) as day_of_week, is_weekend, is_rush_hour from enriched where DOLocationID is not null"
)
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = codec.trip_messages(_enriched(spark, sf_dir))
    return _stamped(codec.parse_trip_events(messages), "pickup_datetime", "dropoff_datetime")


@query(demand_sql(a.FINE_SQL, "inner") + DEMAND_OUT_SQL + " from demand")
def demand_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand_out(codec.parse_demand(codec.demand_messages(_demand(spark, sf_dir, "both_sides"))))


@query(f"with {a.FINE_SQL}, {FLOW_CTE} select {FLOW_OUT_SQL} from flows")
def flow_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(codec.parse_flows(codec.flow_messages(flows.od_flows(a.trips(spark, sf_dir)))), "time_window")


@query(
    f"{RATED_SQL} select {STAMP_SQL.format('time_bucket')} as detected_at, zone_id, cast(pickup_count as integer) as demand_current, round(demand_baseline, 6) as demand_baseline, round(ratio, 6) as ratio, case when ratio >= 3 then 'critical' else 'warning' end as severity from rated where demand_baseline >= 1 and ratio >= 2"
)
def alert_payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = codec.parse_alerts(codec.alert_messages(demand.hotspots(_rated(spark, sf_dir))))
    return parsed.select(stamp("detected_at"), "zone_id", "demand_current", rounded("demand_baseline"), rounded("ratio"), "severity")


@query(
    """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as observation_time, 'KNYC' as station_id, value as temperature_c,
case when event_id % 3 = 0 then round(value / 8 + case when event_id % 2 = 0 then 1.0 else 0.0 end, 6) when event_id % 3 = 1 then round(value / 4, 6) end as precipitation_mm,
case when event_id % 5 <> 0 then value / 2 end as wind_speed_ms, cast(event_id % 100 as double) as humidity_pct, event_type as weather_condition from events"""
)
def weather_payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    n = F.col("event_id")

    def amount(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(value.alias(name)))

    answer = F.struct(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.struct(F.col("value").alias("temp"), (n % 100).alias("humidity")).alias("main"),
        F.struct(F.when(n % 5 != 0, F.col("value") / 2).alias("speed")).alias("wind"),
        F.struct(F.when(n % 3 == 0, F.col("value") / 8).alias("1h"), F.when(n % 3 == 1, F.col("value") / 4).alias("3h")).alias("rain"),
        amount("1h", n % 6 == 0, F.lit(1.0)).alias("snow"),
        F.array(F.struct(F.col("event_type").alias("main"))).alias("weather"),
    )
    flat = codec.flatten_weather(e.select(F.to_json(answer).alias("value")), a.STATION)
    return _stamped(flat, "observation_time").withColumn("precipitation_mm", F.round("precipitation_mm", 6))


# Keyed tables

@query(
    "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1"
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = a.table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tables.last_wins(events, ("user_id", "event_type"), ("ts", "event_id")).select("user_id", "event_type", "event_id", "value")


@query(
    "with b as (select user_id, event_type, cast(max(value) as double) as value from events where event_id % 2 = 1 group by 1, 2), o as (select user_id, event_type, min(value) as value from events where event_id % 2 = 0 group by 1, 2) select coalesce(b.user_id, o.user_id) as user_id, coalesce(b.event_type, o.event_type) as event_type, coalesce(b.value, o.value) as value from b full join o on b.user_id = o.user_id and b.event_type = o.event_type"
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = a.table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    keys = ("user_id", "event_type")
    old = events.where("event_id % 2 = 0").groupBy(*keys).agg(F.min("value").alias("value"))
    return tables.merge(old, events.where("event_id % 2 = 1").drop("event_id"), keys)


@query(
    "select strftime(h, '%Y-%m-%d %H:%M:%S') as \"hour\", event_type from (select distinct date_trunc('hour', ts) as h, event_type from events where event_id % 2 = 1) where (h, event_type) not in (select (date_trunc('hour', ts), event_type) from events where event_id % 2 = 0)"
)
def append_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = a.table(spark, sf_dir, "events").select(temporal.hour_start(F.col("ts")).alias("hour"), "event_type", "event_id")
    old, new = (events.where(F.col("event_id") % 2 == k).drop("event_id") for k in (0, 1))
    return _stamped(tables.append_missing(old, new, ("hour", "event_type")), "hour")


def _noise_sql(salt: int, low: float, high: float, per: str = "id") -> str:
    return f"(cast('0x' || substr(md5('42:{salt}:' || {per}), 1, 7) as bigint) / 268435456.0 * ({high} - ({low})) + ({low}))"


@query(
    f"""with h as (select range as id, 1704067200 + range * 3600 as observed from range(720)),
d as (select *, 18 + 6 * sin(2 * pi() * (((observed // 3600) % 24) - 7) / 24) + {_noise_sql(1, -0.8, 0.8)} as t, {_noise_sql(3, 0.0, 1.0, "(id // 3)")} < 0.15 as wet from h)
select observed, 'KNYC' as station_id, round(t, 2) as temperature_c, case when wet then round({_noise_sql(4, 0.5, 4.0)}, 2) end as precipitation_mm, round({_noise_sql(5, 3.0, 8.0)}, 2) as wind_speed_ms,
round(least(greatest(100 - 1.5 * t + {_noise_sql(2, -5.0, 5.0)}, 40.0), 95.0), 1) as humidity_pct, case when wet then 'Rain' when {_noise_sql(6, 0.0, 1.0)} < 0.35 then 'Clouds' else 'Clear' end as weather_condition from d"""
)
def weather_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic_weather(spark, "2024-01-01T00:00:00Z", 24 * 30)
    return made.withColumn("observed", F.unix_seconds("observation_time")).drop("observation_time")


# Files: written and read again

def _trip_file(spark: SparkSession, sf_dir: str) -> str:
    """Raw trips as a month's file, under the older names of the time columns."""
    folder = scratch_folder(spark, "trips")
    rows = a.trips(spark, sf_dir).withColumn("pickup_datetime", F.when(F.col("event_id") % 11 != 0, F.col("pickup_datetime")))
    rows.drop("event_id").withColumnsRenamed({"pickup_datetime": "pickup_ts", "dropoff_datetime": "Dropoff_TS"}).write.parquet(folder)
    return folder


HOLED_SQL = f"{a.FINE_SQL}, held as (select * replace (case when event_id % 11 <> 0 then pickup_datetime end as pickup_datetime) from trips)"
RAW_ORDER_SQL = "order by pickup_datetime, hvfhs_license_num nulls first, dropoff_datetime nulls first, PULocationID nulls first, DOLocationID nulls first, trip_miles nulls first, trip_time nulls first"


def _numbered(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


@query(f"with {HOLED_SQL} select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, PULocationID from held")
def trip_file_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_trips(spark, _trip_file(spark, sf_dir), "pickup_datetime", "PULocationID").withColumn("pickup_datetime", temporal.wall_clock(F.col("pickup_datetime")))


@query(
    f"with {HOLED_SQL} select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, hvfhs_license_num, PULocationID, DOLocationID, trip_miles, row_number() over ({RAW_ORDER_SQL}) as position from held where pickup_datetime is not null"
)
def trip_file_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of a file in the order that a replay sends them; the place of each row is read off the file that they are written to."""
    rows = readers.read_trips(spark, _trip_file(spark, sf_dir), ordered=True)
    return _stamped(_in_file_order(rows.select("pickup_datetime", "hvfhs_license_num", "PULocationID", "DOLocationID", "trip_miles")), "pickup_datetime")


def _in_file_order(rows: DataFrame) -> DataFrame:
    """The rows with their position over the files of a sorted table, one after another."""
    folder = scratch_folder(rows.sparkSession, "ordered")
    rows.write.parquet(folder)
    again = rows.sparkSession.read.schema(rows.schema).parquet(folder).withColumns({"_f": F.input_file_name(), "_r": F.col("_metadata.row_index")})
    # A row for each file.
    before = again.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_f").alias("_g"), (F.sum("_n").over(Window.orderBy("_f")) - F.col("_n")).alias("_before"))
    return again.join(before, F.col("_f") == F.col("_g")).withColumn("position", F.col("_before") + F.col("_r") + 1).drop("_f", "_g", "_r", "_before")


@query(f"with {a.FINE_SQL} select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, hvfhs_license_num, PULocationID from trips {RAW_ORDER_SQL} limit 100")
def replay_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.trips(spark, sf_dir).select(*schemas.RAW_TRIP.names)
    return _stamped(replay.first_events(rows, 100, "pickup_datetime"), "pickup_datetime").select("pickup_datetime", "hvfhs_license_num", "PULocationID")


@query(
    f"with {a.FINE_SQL}, f as (select epoch_us(min(pickup_datetime)) as first from trips) select event_id, round((epoch_us(pickup_datetime) - first) / 1e6 / 100, 6) as due_seconds from trips, f"
)
def replay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.schedule(a.trips(spark, sf_dir), "pickup_datetime", 100.0).select("event_id", rounded("due_seconds"))


@query(
    f"with {a.FINE_SQL} select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, hvfhs_license_num, PULocationID, DOLocationID, trip_miles from trips where PULocationID is not null"
)
def replay_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips replayed into a topic of files, much faster than they were, and parsed from it again."""
    folder = scratch_folder(spark, "replayed")
    trips = _instants(a.trips(spark, sf_dir), "pickup_datetime", "dropoff_datetime")
    replay.replay_trips(trips, replay.topic_writer("files", folder), speed=1e6, wait=lambda _: None)
    found = codec.from_messages(spark.read.schema("key string, value string").json(folder), schemas.RAW_TRIP)
    return _stamped(found, "pickup_datetime").select("pickup_datetime", "hvfhs_license_num", "PULocationID", "DOLocationID", "trip_miles")


@query(f"""with {a.FINE_SQL}, {a.WEATHER_SQL} select {STAMP_SQL.format('observation_time')} as observation_time, station_id, temperature_c, precipitation_mm, weather_condition from weather""")
def weather_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations through CSV, whose times state no offset and are UTC."""
    folder = scratch_folder(spark, "weather")
    rows = a.weather(spark, sf_dir)
    columns = [c if c != "observation_time" else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in reversed(rows.columns)]
    rows.select(*columns).write.option("header", True).csv(folder)
    read = readers.read_weather(spark, folder)
    shown = F.date_format(F.to_utc_timestamp("observation_time", F.current_timezone()), temporal.WALL_CLOCK)
    return read.select(shown.alias("observation_time"), "station_id", "temperature_c", "precipitation_mm", "weather_condition")


@query(
    f"with {a.COARSE_SQL}, {BASELINE_CTE.format(zones=a.COARSE)} select zone_id, hour_of_week, round(baseline_mean_pickups, 6) as baseline_mean_pickups, row_number() over (order by zone_id, hour_of_week) as position from baseline"
)
def baseline_file_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup as the one ordered CSV file that the demand job reads; positions are those in the file."""
    path = base.write_baseline(_baseline(spark, sf_dir, a.COARSE), f"{scratch_folder(spark, 'baseline')}/baseline.csv")
    found = readers.read_baseline(spark, path).withColumn("_line", F.monotonically_increasing_id())
    return _numbered(found, ("_line",)).select("zone_id", "hour_of_week", rounded("baseline_mean_pickups"), "position")


APPROXIMATE_SQL = ", ".join(f"true as p{p}_close" for p in (50, 90, 99))


@query(f"select {APPROXIMATE_SQL}")
def baseline_summary_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each approximate quantile lies between the exact ones a thousandth to either side of it, and one row more."""
    grid = _baseline(spark, sf_dir, a.COARSE)
    found = base.summary(grid, exact=False).select("p50", "p90", "p99", "cells")
    value, step = F.col("baseline_mean_pickups"), 0.002
    bounds = grid.agg(*(F.percentile(value, F.lit(min(1.0, max(0.0, p / 100 + d * step)))).alias(f"{n}{p}") for p in (50, 90, 99) for n, d in (("low", -1), ("high", 1)))).first()
    return found.select(*(F.col(f"p{p}").between(bounds[f"low{p}"], bounds[f"high{p}"]).alias(f"p{p}_close") for p in (50, 90, 99)))


@query(
    f"""with {a.FINE_SQL}, c as (select count(*) as n, strftime(min(pickup_datetime), '%Y-%m') = '2024-01' and strftime(max(pickup_datetime), '%Y-%m') = '2024-01' as m from trips)
select n as "rows", false as enough, m as in_month, 'fhvhv_tripdata_2024-01.parquet' as file, false as passed from c"""
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a month's file through its JSON report."""
    name = "fhvhv_tripdata_2024-01.parquet"
    found = checks.validate_trips(a.trips(spark, sf_dir).drop("event_id"), checks.month_of_file(name))
    path = tables.write_report(found, name, scratch_folder(spark, "reports"))
    read = spark.read.schema("rows long, checks map<string, boolean>, errors array<string>, passed boolean, file string").json(path)
    return read.select("rows", F.col("checks")["row_count"].alias("enough"), F.col("checks")["month"].alias("in_month"), "file", "passed")


# Streams: the events as a topic of several files in the order of time, one for each micro-batch

SLICES = 5


def _slice(time: str) -> Column:
    """The number of the file that a row is in: the month in even parts."""
    return F.least(F.floor((F.dayofmonth(time) - 1) * SLICES / 31), F.lit(SLICES - 1))


def _topic(rows: DataFrame, time: str, folder: str, numbers: range = range(SLICES)) -> None:
    """Append the rows to a folder, a file for each slice of time, one after another."""
    for k in numbers:
        rows.where(_slice(time) == k).repartition(1).write.mode("append").parquet(folder)


def _read_topic(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through a folder that a stream can watch."""
    events = a.table(spark, sf_dir, "events")
    folder = scratch_folder(spark, "topic")
    _topic(events, "ts", folder)
    return _read_topic(spark, folder, events)


def _instants(df: DataFrame, *names: str) -> DataFrame:
    """Watermarks need instants: the wall clock is taken in the session's zone, and read back in it."""
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def _run(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and read that. few: of few rows in its state, which takes a partition for each core at most."""
    spark = df.sparkSession
    folder = scratch_folder(spark, f"stream-{name}")
    writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    width = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if few:
            spark.conf.set("spark.sql.shuffle.partitions", min(int(width), spark.sparkContext.defaultParallelism))
        # A query keeps the settings that it starts with.
        running = writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _stream_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(a.as_trips(_event_stream(spark, sf_dir)), "pickup_datetime", "dropoff_datetime")


@query(
    f"with {a.FINE_SQL}, {FLOW_CTE} select {FLOW_OUT_SQL} from flows where time_window + interval '1 hour' <= (select max(pickup_datetime) - interval '30 minutes' from trips)"
)
def stream_od_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stamped(_run(jobs.flow_stream(_stream_trips(spark, sf_dir)), "flows"), "time_window")


#: Windows that the lesser of the two watermarks has passed.
CLOSED_SQL = " where time_bucket + interval '15 minutes' <= (select least(max(pickup_datetime), max(dropoff_datetime)) - interval '30 minutes' from trips)"
STREAM_DEMAND_SQL = f"""with {a.FINE_SQL}, {DEMAND_CTE.format(join='inner').replace('left join hourly w on', "left join (select null::double as temperature_c, null::double as precipitation_mm, null::timestamp as observation_time where false) w on")}
{DEMAND_OUT_SQL} from demand {CLOSED_SQL}"""


@query(STREAM_DEMAND_SQL)
def stream_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over several micro-batches, with rides that end long after the delay."""
    none = {c: F.lit(None).cast("double") for c in ("weather_temperature_c", "weather_precipitation_mm")}
    return _demand_out(_run(jobs.demand_stream(_stream_trips(spark, sf_dir).withColumns(none)), "demand"))


@query(demand_sql(a.FINE_SQL, "inner").replace("from events where event_type = 'error'", "from events") + DEMAND_OUT_SQL + f" from demand {CLOSED_SQL}")
def stream_demand_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs, one after the other's topic: trips joined with weather, and demand of what comes out, both resumed from their checkpoints for each file."""
    folder = scratch_folder(spark, "chain")
    events = a.table(spark, sf_dir, "events")
    # The greatest observation of each hour, as the batch form takes it, is in the topic alone.
    weather = enrich.hourly_weather(a.observations(events))
    trips = a.as_trips(events)
    both = ((trips, "pickup_datetime", "trips"), (weather, "observation_time", "weather"))
    for k in range(SLICES):
        for rows, time, name in both:
            _topic(rows, time, f"{folder}/{name}", range(k, k + 1))
        told, seen = (_instants(_read_topic(spark, f"{folder}/{name}", rows), *times) for (rows, _, name), times in zip(both, (("pickup_datetime", "dropoff_datetime"), ("observation_time",)), strict=True))
        jobs.start_messages(codec.trip_weather_messages(_stream_enriched(told, a.zones(spark, sf_dir), seen)), "files", f"{folder}/joined", "weather", {"availableNow": True}, root=f"{folder}/checkpoints").awaitTermination()
        messages = readers.stream_messages(spark, "files", f"{folder}/joined")
        rows = jobs.demand_stream(readers.stream_enriched_trips(messages, with_weather=True))
        writer = rows.writeStream.format("parquet").option("path", f"{folder}/demand").option("checkpointLocation", f"{folder}/checkpoints/demand")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return _demand_out(spark.read.schema(rows.schema).parquet(f"{folder}/demand"))


def _stream_enriched(trips: DataFrame, zones: DataFrame, weather: DataFrame) -> DataFrame:
    return jobs.weather_stream(jobs.enrich_stream(trips, zones), weather)


STREAM_WEATHER_SQL = f"""with {a.FINE_SQL}, {a.WEATHER_SQL},
mark as (select least((select max(date_trunc('hour', pickup_datetime)) from trips) - interval '30 minutes', (select max(date_trunc('hour', observation_time)) from weather) - interval '2 hours') as m)
select event_id, w.temperature_c as weather_temperature_c, w.weather_condition from trips left join weather w on date_trunc('hour', pickup_datetime) = date_trunc('hour', observation_time), mark
where w.observation_time is not null or date_trunc('hour', pickup_datetime) <= m"""


@query(STREAM_WEATHER_SQL)
def stream_weather_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's table holds pairs of blocks of trips and observations: every trip of an hour meets each of its observations."""
    events, folder = a.table(spark, sf_dir, "events"), scratch_folder(spark, "topic")
    _topic(events, "ts", folder)
    # Two streams over one topic.
    weather = _instants(a.raw_weather(_read_topic(spark, folder, events)), "observation_time")
    trips = _instants(a.as_trips(_read_topic(spark, folder, events)).select("event_id", "pickup_datetime"), "pickup_datetime")
    pairs = _run(jobs.weather_pair_stream(trips, weather), "weather", few=True)
    kept = pairs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return enrich.unfold_kept_weather(kept, "_file", "_row").select("event_id", "weather_temperature_c", "weather_condition")


@query(f"with {a.FINE_SQL}, {FLOW_CTE} select {DEGREE_OUT_SQL} from flows")
def stream_flow_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow messages through the sink into the keyed table, with degrees over whole windows."""
    folder = scratch_folder(spark, "store")
    messages = codec.flow_messages(_instants(flows.od_flows(a.trips(spark, sf_dir)), "time_window"))
    messages.write.json(f"{folder}/topic")
    store = tables.TableStore(spark, f"{folder}/tables")
    stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 4).json(f"{folder}/topic")
    jobs.start_sink(stream, "network_flows", store, f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return _stamped(store.read("network_flows"), "time_window")


def _sink_table(spark: SparkSession, table: str, messages: DataFrame) -> DataFrame:
    """Messages in several files through the sink into a keyed table, twice: the second query, of a new checkpoint, changes nothing."""
    folder = scratch_folder(spark, f"sink-{table}")
    messages.repartition(3).write.json(f"{folder}/topic")
    store = tables.TableStore(spark, f"{folder}/tables")
    for n in range(2):
        stream = readers.stream_messages(spark, "files", f"{folder}/topic", per_trigger=2)
        jobs.start_sink(stream, table, store, f"{folder}/checkpoint{n}", {"availableNow": True}).awaitTermination()
    return store.read(table)


@query(
    f"with {a.FINE_SQL}, {a.ZONES_SQL}, {ENRICHED_SQL}, rows as (select {STAMP_SQL.format('pickup_datetime')} as pickup_datetime, {STAMP_SQL.format('dropoff_datetime')} as dropoff_datetime, PULocationID as pu_zone_id, DOLocationID as do_zone_id, trip_miles, trip_time / 60.0 as trip_time_min, cast(hour_of_day as integer) as hour_of_day, cast(day_of_week as integer) as day_of_week, is_weekend, is_rush_hour from enriched where DOLocationID is not null) select * from rows qualify row_number() over (partition by pickup_datetime, dropoff_datetime, pu_zone_id, do_zone_id order by trip_miles desc, trip_time_min desc) = 1"
)
def stream_trip_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sink_table(spark, "trip_events", codec.trip_messages(_enriched(spark, sf_dir)))
    return _stamped(found, "pickup_datetime", "dropoff_datetime")


@query(demand_sql(a.FINE_SQL, "inner") + DEMAND_OUT_SQL + " from demand")
def stream_demand_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demand_out(_sink_table(spark, "hourly_demand", codec.demand_messages(_demand(spark, sf_dir, "both_sides"))))


@query(
    f"{RATED_SQL} select {STAMP_SQL.format('time_bucket')} as detected_at, zone_id, cast(pickup_count as integer) as demand_current, round(demand_baseline, 6) as demand_baseline, round(ratio, 6) as ratio, case when ratio >= 3 then 'critical' else 'warning' end as severity from rated where demand_baseline >= 1 and ratio >= 2"
)
def stream_alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _sink_table(spark, "hotspot_alerts", codec.alert_messages(demand.hotspots(_rated(spark, sf_dir))))
    return found.select(stamp("detected_at"), "zone_id", "demand_current", rounded("demand_baseline"), rounded("ratio"), "severity")


@query(
    f"with {a.ZONES_SQL}, new as (select cast(s_suppkey as integer) as zone_id, s_name as zone_name, 'new' as borough, 1.0::double as centroid_lat, 2.0::double as centroid_lon from supplier where s_suppkey between 20 and 40) select * from new union all select * from zones where zone_id not in (select zone_id from new)"
)
def zone_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone table, loaded once and then with some zones changed and some new."""
    store = tables.TableStore(spark, scratch_folder(spark, "zones"))
    store.write("taxi_zones", a.zones(spark, sf_dir), 0)
    new = a.table(spark, sf_dir, "supplier").where("s_suppkey between 20 and 40")
    store.write("taxi_zones", new.select(F.col("s_suppkey").cast("int").alias("zone_id"), F.col("s_name").alias("zone_name"), F.lit("new").alias("borough"), F.lit(1.0).alias("centroid_lat"), F.lit(2.0).alias("centroid_lon")), 1)
    return store.read("taxi_zones")


@query(f"with {a.FINE_SQL}, {a.ZONES_SQL}, {ENRICHED_SQL} select {ENRICHED_OUT_SQL} from enriched")
def stream_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = jobs.enrich_stream(_stream_trips(spark, sf_dir).drop("event_id"), a.zones(spark, sf_dir))
    return _stamped(_run(enriched, "enriched"), "pickup_datetime", "dropoff_datetime")
