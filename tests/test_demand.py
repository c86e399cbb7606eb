"""Demand, baseline, alerts, flows on known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from zonecast import schemas
from zonecast.functions import codec
from zonecast.operators import baseline, checks, demand, flows


def events(spark, *rows):
    """(pickup, dropoff, from, to, miles, seconds, temperature, rain)."""
    made = spark.createDataFrame([(*r, *(2.0, 600.0, 20.0, 0.0)[len(r) - 4 :]) for r in rows], "p string, d string, PULocationID int, DOLocationID int, trip_miles double, trip_time double, weather_temperature_c double, weather_precipitation_mm double")
    return made.withColumns({"pickup_datetime": F.to_timestamp("p"), "dropoff_datetime": F.to_timestamp("d")}).drop("p", "d")


def told(df, *names):
    return {(r.at, r.zone_id): tuple(r[n] for n in names) for r in df.withColumn("at", F.date_format("time_bucket", "HH:mm")).collect()}


DAY = "2024-07-15 "


def test_three_zones(spark):
    rows = events(
        spark,
        (DAY + "14:30", DAY + "14:42", 230, 138, 2.0),
        (DAY + "14:38", DAY + "14:55", 230, 230, 4.0),
        (DAY + "14:46", DAY + "14:58", 230, 230, 6.0),
        (DAY + "14:32", DAY + "14:40", 138, 230, 8.0),
    )
    found = told(demand.zone_demand(rows), "pickup_count", "dropoff_count", "avg_trip_miles")
    assert found == {("14:30", 230): (2, 1, 3.0), ("14:45", 230): (1, 2, 6.0), ("14:30", 138): (1, 1, 8.0)}


def test_window_bounds_and_sides(spark):
    rows = events(spark, (DAY + "14:30:00", DAY + "14:31", 1, 1), (DAY + "14:45:00", DAY + "14:46", 1, 1), (DAY + "15:00", DAY + "15:01", 2, 3))
    both = told(demand.zone_demand(rows), "pickup_count", "dropoff_count")
    assert both == {("14:30", 1): (1, 1), ("14:45", 1): (1, 1)}
    either = told(demand.zone_demand(rows, mode="either_side"), "pickup_count", "dropoff_count", "avg_trip_miles")
    assert either["15:00", 2] == (1, 0, 2.0) and either["15:00", 3] == (0, 1, None)
    with pytest.raises(ValueError, match="mode"):
        demand.zone_demand(rows, mode="other")


def test_averages(spark):
    rows = events(spark, (DAY + "14:30", DAY + "14:31", 1, 1, 1.0, 600.0, 20.0, 0.5), (DAY + "14:31", DAY + "14:32", 1, 1, 3.0, 1200.0, None, 1.5), (None, DAY + "14:33", 1, 1), (DAY + "14:34", None, 1, None, 5.0))
    row = demand.zone_demand(rows).first()
    assert (row.pickup_count, row.dropoff_count, row.avg_trip_miles, row.avg_trip_time) == (3, 3, 3.0, pytest.approx(13.3333333))
    assert (row.avg_temperature, row.precipitation_mm) == (20.0, pytest.approx(2 / 3))
    dry = demand.zone_demand(events(spark, (DAY + "14:30", DAY + "14:31", 1, 1, 1.0, 60.0, None, None))).first()
    assert dry.avg_temperature is None and "avg_temperature" in json.loads(codec.demand_messages(demand.zone_demand(events(spark, (DAY + "14:30", DAY + "14:31", 1, 1, 1.0, 60.0, None, None)))).first().value)


def rated(spark, at, count, *cells):
    made = spark.createDataFrame([(at, 1, count)], "t string, zone_id int, pickup_count int").withColumn("time_bucket", F.to_timestamp("t"))
    return demand.attach_baseline(made, spark.createDataFrame(cells, schemas.BASELINE))


def test_ratios(spark):
    row = rated(spark, "2024-07-15 14:30", 100, (1, 14, 200.0), (1, 15, 1.0)).first()
    assert (row.demand_baseline, row.ratio) == (50.0, 2.0)
    assert rated(spark, "2024-07-14 09:00", 50, (1, 153, 80.0)).first().ratio == 2.5
    for cell in ((9, 14, 200.0), (1, 14, 0.0), (1, 14, None)):
        assert rated(spark, "2024-07-15 14:30", 100, cell).first().ratio is None


@pytest.mark.parametrize(("count", "mean", "want"), [(198, 400.0, None), (200, 400.0, "warning"), (298, 400.0, "warning"), (300, 400.0, "critical"), (1000, 400.0, "critical"), (200, 2.0, None), (9, 0.0, None), (9, None, None)])
def test_alerts(spark, count, mean, want):
    found = demand.hotspots(rated(spark, "2024-07-15 14:30", count, (1, 14, mean))).collect()
    assert [r.severity for r in found] == ([want] if want else [])


def test_flows(spark):
    rows = events(
        spark, (DAY + "14:30", None, 230, 138), (DAY + "14:45", None, 230, 138), (DAY + "15:10", None, 230, 138), (DAY + "14:50", None, 230, 132), (DAY + "14:00:00", None, 138, 138), (DAY + "15:00:00", None, 138, 138), (DAY + "14:20", None, None, 1), (DAY + "14:20", None, 1, None), (None, None, 1, 1)
    )
    found = flows.with_degrees(flows.od_flows(rows)).withColumn("h", F.hour("time_window"))
    assert {(r.h, r.origin_zone_id, r.dest_zone_id): (r.trip_count, r.in_degree, r.out_degree) for r in found.collect()} == {
        (14, 230, 138): (2, 3, 3), (15, 230, 138): (1, 2, 1), (14, 230, 132): (1, 1, 3), (14, 138, 138): (1, 3, 1), (15, 138, 138): (1, 2, 1),
    }
    many = spark.range(600).select(F.to_timestamp(F.lit(DAY + "10:00")).alias("time_window"), F.lit(1).alias("origin_zone_id"), F.col("id").cast("int").alias("dest_zone_id"), F.lit(1).alias("trip_count"))
    assert {r.out_degree for r in flows.with_degrees(many).collect()} == {600}


def weeks(spark, *days):
    return spark.createDataFrame([(d, 1) for d in days], "d string, PULocationID int").select(F.to_timestamp("d").alias("pickup_datetime"), "PULocationID")


def test_complete_weeks(spark):
    """Over a year's end, with more than ten weeks: the first and the last week by date go."""
    days = [f"{m}" for m in ("2024-10-07", "2024-10-14", "2024-11-04", "2024-12-02", "2024-12-30", "2025-01-01", "2025-01-06", "2025-02-03 10:00", "2025-02-10", "2025-03-03", "2025-03-10", "2025-03-17", "2025-03-24", "2025-03-31")]
    kept, count = baseline.complete_weeks(weeks(spark, *days))
    assert count == 11 and kept.agg(F.min("pickup_datetime"), F.max("pickup_datetime")).first()[0].isoformat().startswith("2024-10-14") and kept.count() == 12
    for short in ((), ("2024-10-07", "2024-10-14")):
        with pytest.raises(ValueError, match="few|no trips"):
            baseline.complete_weeks(weeks(spark, *short))


def test_baseline(spark):
    kept, count = baseline.complete_weeks(weeks(spark, "2024-07-01", "2024-07-08 14:10", "2024-07-08 14:20", "2024-07-15 14:00", "2024-07-22"))
    grid = baseline.zone_baseline(spark, kept, count, 3)
    assert grid.count() == 3 * 168 and baseline.zone_hour_grid(spark, 263).count() == 44_184
    assert {tuple(r) for r in grid.where("baseline_mean_pickups > 0").collect()} == {(1, 14, 1.5)}
    told = baseline.summary(grid).first()
    assert (told.cells, told.zones, told.hours, told.greatest, told.low_cells) == (504, 3, 168, 1.5, 503)
    assert [r.zone_id for r in baseline.ranked_zones(grid, 2).collect()] == [1, 2] and [r.zone_id for r in baseline.ranked_zones(grid, 2, busiest=False).collect()] == [2, 3]
    assert baseline.summary(grid, exact=False).first().p99 == 0.0


def test_checks(spark):
    rows = events(spark, (DAY + "14:30", None, 1, 265), (DAY + "15:30", None, None, 300), (None, None, 2, None))
    nulls = {r.column_name: (round(r.null_fraction, 3), r.ok) for r in checks.null_fractions(rows).collect()}
    assert nulls == {"pickup_datetime": (0.333, False), "PULocationID": (0.333, False), "DOLocationID": (0.333, False)}
    assert {r.column_name: (r.least, r.greatest, r.ok) for r in checks.zone_ranges(rows).collect()} == {"PULocationID": (1, 2, True), "DOLocationID": (265, 300, False)}
    assert not checks.zone_ranges(rows.where("false")).first().ok
    assert checks.month_range(rows, "2024-07").first().ok and not checks.month_range(rows, "2024-08").first().ok
    assert tuple(checks.row_counts(rows).first()) == (3, 1, pytest.approx(2 / 3))
    whole = rows.withColumn("hvfhs_license_num", F.lit("x"))
    report = checks.validate_trips(whole, "2024-07", least_rows=1).first()
    assert not report.passed and set(report.errors) == {"nulls pickup_datetime", "nulls PULocationID", "nulls DOLocationID", "zones DOLocationID"}
    assert checks.validate_trips(whole.withColumnRenamed("pickup_datetime", "Pickup_TS"), least_rows=1).first().checks["columns"]
    assert checks.validate_trips(rows).first().errors == ["missing column hvfhs_license_num"]
