"""Replays, fetched files, reports and ordered files."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_demand import DAY, events
from zonecast import schemas, session
from zonecast.functions import temporal
from zonecast.operators import baseline, checks
from zonecast.sources import fetch, readers, tables
from zonecast.streaming import replay


def trips(spark, count=5):
    made = events(spark, *((DAY + f"14:{30 + k:02d}", DAY + f"14:{40 + k:02d}", 161, 100 + k, k + 1.0) for k in reversed(range(count))))
    return made.withColumn("hvfhs_license_num", F.lit("HV1")).select(*schemas.RAW_TRIP.names)


def sent(spark, path):
    return readers.codec.from_messages(spark.read.schema("key string, value string").json(path), schemas.RAW_TRIP)


def test_schedule_and_first(spark):
    due = {r.DOLocationID: r.due_seconds for r in replay.schedule(trips(spark), "pickup_datetime", 60.0).collect()}
    assert due == {100 + k: float(k) for k in range(5)}
    assert [r.DOLocationID for r in replay.first_events(trips(spark), 2, "pickup_datetime").collect()] == [100, 101]
    assert replay.first_events(trips(spark).union(trips(spark)), 3, "pickup_datetime").count() == 3


def test_replay(spark, tmp_path):
    """One message a minute, sixty times as fast: a slice a second, in order, with the times as they were."""
    waits, write = [], replay.topic_writer("files", f"{tmp_path}/t")
    assert replay.replay_trips(trips(spark), write, speed=60.0, wait=waits.append, now=lambda: sum(waits)) == 5
    assert waits == [1.0] * 4
    assert sent(spark, f"{tmp_path}/t").exceptAll(trips(spark)).count() == 0 and sent(spark, f"{tmp_path}/t").count() == 5
    raw = json.loads(spark.read.json(f"{tmp_path}/t").first().value)
    assert raw["pickup_datetime"].endswith("+00:00") and raw["pickup_datetime"].startswith("2024-07-15T18:3")


def test_replay_behind_time(spark, tmp_path):
    """Writes that take longer than a slice are never waited for, and lose nothing."""
    waits, ticks, write = [], iter(range(0, 1000, 100)), replay.topic_writer("files", f"{tmp_path}/b")
    assert replay.replay_trips(trips(spark), write, speed=60.0, wait=waits.append, now=lambda: next(ticks)) == 5
    assert waits == [] and sent(spark, f"{tmp_path}/b").count() == 5


def test_replay_loops_and_stops(spark, tmp_path):
    quick = {"speed": 60.0, "wait": lambda _: None}
    assert replay.replay_trips(trips(spark), replay.topic_writer("files", f"{tmp_path}/l"), loop=True, max_events=12, **quick) == 12
    assert sent(spark, f"{tmp_path}/l").groupBy("DOLocationID").count().orderBy("DOLocationID").collect()[0]["count"] == 3
    asked = iter([False, False, False, True, True])
    assert replay.replay_trips(trips(spark), replay.topic_writer("files", f"{tmp_path}/s"), stop=lambda: next(asked), **quick) == 2
    assert replay.replay_trips(trips(spark).where("false"), replay.topic_writer("files", f"{tmp_path}/e"), loop=True, **quick) == 0
    with pytest.raises(ValueError, match="topic"):
        replay.topic_writer("other", "x")


def test_replay_now(spark, tmp_path):
    replay.replay_trips(trips(spark), replay.topic_writer("files", f"{tmp_path}/n"), anchor="now", speed=1e6)
    first = sent(spark, f"{tmp_path}/n").agg(F.min(F.abs(F.unix_seconds("pickup_datetime") - F.unix_seconds(F.current_timestamp())))).first()[0]
    assert first < 120


def test_replay_weather(spark, tmp_path):
    rows = spark.createDataFrame([(DAY + f"1{k}:00", "K", 1.0 * k, None, 2.0, 3.0, "Rain") for k in range(3)], "t string, station_id string, temperature_c double, precipitation_mm double, wind_speed_ms double, humidity_pct double, weather_condition string")
    rows = rows.withColumn("observation_time", F.to_timestamp("t")).select(*schemas.WEATHER.names)
    assert replay.replay_weather(rows, replay.topic_writer("files", f"{tmp_path}/w"), speed=1e6) == 3
    found = readers.codec.from_messages(spark.read.schema("key string, value string").json(f"{tmp_path}/w"), schemas.WEATHER)
    assert found.exceptAll(rows).count() == 0 and spark.read.json(f"{tmp_path}/w").first().key == "K"


def test_gaps_over_slices(spark):
    """Over many hours, with ties and a row without a time, as one window would have it."""
    rows = spark.range(500).select("id", F.when(F.col("id") != 7, F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(400)) * 600)).alias("at"))
    got = {r.id: r.gap_seconds for r in tables.gaps(rows, "at", "id").collect()}
    times = sorted((r.at, r.id) for r in rows.where("at is not null").collect())
    want = {7: 0.0, times[0][1]: 0.0} | {b[1]: (b[0] - a[0]).total_seconds() for a, b in zip(times, times[1:], strict=False)}
    assert got == want


def test_ordered_readers(spark, tmp_path):
    trips(spark).repartition(3).write.parquet(f"{tmp_path}/t")
    assert [r.DOLocationID for r in readers.read_trips(spark, f"{tmp_path}/t", ordered=True).collect()] == [100, 101, 102, 103, 104]
    Path(f"{tmp_path}/w.csv").write_text("station_id,observation_time,temperature_c,precipitation_mm,wind_speed_ms,humidity_pct,weather_condition\nB,2024-07-15T18:00:00,x,,1,2,Rain\nA,2024-07-15T17:00:00Z,1.5,NaN,1,2,Rain\n")
    assert [(r.station_id, r.temperature_c, r.precipitation_mm) for r in readers.read_weather(spark, f"{tmp_path}/w.csv", ordered=True).collect()] == [("A", 1.5, None), ("B", None, None)]
    Path(f"{tmp_path}/v.csv").write_text("station_id,observation_time\nB,2024-07-15T18:00:00\n")
    with pytest.raises(ValueError, match="humidity_pct"):
        readers.read_weather(spark, f"{tmp_path}/v.csv")


def test_baseline_file(spark, tmp_path):
    kept = spark.createDataFrame([(z, h, float(z * h)) for z in (2, 1) for h in (3, 0, 1)], schemas.BASELINE).repartition(4)
    path = baseline.write_baseline(kept, f"{tmp_path}/b.csv")
    assert [line.split(",")[:2] for line in Path(path).read_text().splitlines()[1:]] == [[str(z), str(h)] for z in (1, 2) for h in (0, 1, 3)]
    held = readers.read_baseline(spark, path, keep=True)
    assert held.is_cached and held.exceptAll(kept).count() == 0
    held.unpersist()


def test_report(spark, tmp_path):
    path = tables.write_report(checks.validate_trips(trips(spark), "2024-07"), "/x/fhvhv_tripdata_2024-07.parquet", f"{tmp_path}")
    told = json.loads(Path(path).read_text())
    assert told["errors"] == ["row_count"] and told["rows"] == 5 and not told["passed"] and Path(path).name.startswith("fhvhv_tripdata_2024-07__")


def test_fetch(spark, tmp_path):
    """A file comes once; a broken one comes again; one that is not there is told."""
    months = temporal.month_series(spark, "2024-01", "2024-03")
    for month in ("2024-01", "2024-02"):
        trips(spark).coalesce(1).write.parquet(f"{tmp_path}/{month}")
        next(Path(f"{tmp_path}/{month}").glob("part-*.parquet")).rename(f"{tmp_path}/source-{month}.parquet")
    paths = (lambda m: f"file://{tmp_path}/source-{m}.parquet"), (lambda m: f"{tmp_path}/got-{m}.parquet")
    assert fetch.fetch_months(spark, months, *paths) == {"2024-01": True, "2024-02": True, "2024-03": False}
    before = Path(paths[1]("2024-01")).stat().st_mtime_ns
    Path(paths[1]("2024-02")).write_bytes(b"cut off")
    assert fetch.fetch_months(spark, months, *paths)["2024-02"] and spark.read.parquet(paths[1]("2024-02")).count() == 5
    assert Path(paths[1]("2024-01")).stat().st_mtime_ns == before and not list(tmp_path.glob("*.part"))


def test_fetch_weather(spark, tmp_path):
    Path(f"{tmp_path}/a.json").write_text(json.dumps({"dt": 1_720_000_123, "main": {"temp": 22.5, "humidity": 60}, "wind": {"speed": 3.4}, "weather": [{"main": "Clouds"}], "rain": {"1h": 0.5}}))
    url = f"file://{tmp_path}/a.json"
    row = fetch.fetch_weather(spark, url, "KNYC")
    assert [(r.temperature_c, r.humidity_pct, r.wind_speed_ms, r.weather_condition, r.precipitation_mm) for r in row.collect()] == [(22.5, 60.0, 3.4, "Clouds", 0.5)]
    assert fetch.fetch_weather(spark, url, "KNYC", row).count() == 0 and fetch.fetch_weather(spark, url, "OTHER", row).count() == 1


def test_centroids(spark, tmp_path):
    """A square with a hole to one side, a zone of two parts, and one without area."""
    square = lambda x, y, s: [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]
    shapes = [
        (1, "Polygon", [square(-74.0, 40.0, 0.2)]),
        (2, "MultiPolygon", [[square(0, 0, 1)], [square(3, 0, 1)]]),
        (3, "Polygon", [square(0, 0, 4), square(0, 0, 2)[::-1]]),
        (4, "Polygon", [[[1, 1], [1, 1], [1, 1], [1, 1]]]),
    ]
    told = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"LocationID": k, "zone": "z"}, "geometry": {"type": t, "coordinates": c}} for k, t, c in shapes]}
    Path(f"{tmp_path}/z.geojson").write_text(json.dumps(told))
    found = {r.zone_id: (round(r.centroid_lat, 9), round(r.centroid_lon, 9)) for r in fetch.zone_centroids(fetch.read_outlines(spark, f"{tmp_path}/z.geojson")).collect()}
    assert found == {1: (40.1, -73.9), 2: (0.5, 2.0), 3: (round(28 / 12, 9), round(28 / 12, 9))}


def test_shared_folder(spark, monkeypatch):
    """Where no folder is set, a session of several machines is refused, and none of their own is used."""
    class Apart:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Apart)
    monkeypatch.delenv("CHECKPOINT_DIR", raising=False)
    assert session.checkpoint_path("q").startswith(session.shared_folder(spark))
