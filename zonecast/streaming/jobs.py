"""Structured Streaming jobs. Every job takes its streams, so that it runs on any carrier, and returns started queries."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from zonecast.functions import codec
from zonecast.operators import demand, enrich, flows
from zonecast.session import checkpoint_path
from zonecast.sources import readers
from zonecast.sources.tables import TableStore

TRIP_DELAY, WEATHER_DELAY = "30 minutes", "2 hours"


class Topic(NamedTuple):
    partitions: int
    key: str
    keep_hours: int


#: Topics between the jobs. Fixed values.
TOPICS = {
    "ride-events-raw": Topic(12, "PULocationID", 24),
    "ride-events-enriched": Topic(12, "PULocationID", 48),
    "demand-per-zone": Topic(6, "zone_id", 168),
    "hotspot-alerts": Topic(3, "zone_id", 24),
    "forecast-results": Topic(6, "zone_id", 168),
    "weather-events": Topic(3, "station_id", 48),
    "ride-events-enriched-weather": Topic(12, "PULocationID", 48),
    "network-flow-updates": Topic(6, "origin_zone_id", 168),
}
TRIGGERS = {"enrich": "10 seconds", "weather": "30 seconds", "demand": "10 seconds", "flows": "30 minutes", "sink": "30 seconds"}


def trigger_of(job: str, part: str | None = None) -> dict:
    """The job's trigger: TRIGGER_<JOB>_<PART>, else TRIGGER_<JOB> from the environment, ``once`` for all that is there, else the default."""
    names = [f"TRIGGER_{job.upper()}"] if part is None else [f"TRIGGER_{job.upper()}_{part.upper()}", f"TRIGGER_{job.upper()}"]
    interval = next((v for n in names if (v := os.environ.get(n))), TRIGGERS[job])
    return {"availableNow": True} if interval == "once" else {"processingTime": interval}


def start_messages(messages: DataFrame, kind: str, target: str, name: str, trigger: dict, mode: str = "append", root: str | None = None) -> StreamingQuery:
    """Write (key, value) to a topic (``kafka``), a folder of JSON lines (``files``), a table in memory or the console."""
    writer = messages.writeStream.queryName(name).outputMode(mode).trigger(**trigger)
    if kind in ("kafka", "files"):
        writer = writer.option("checkpointLocation", f"{root}/{name}" if root else checkpoint_path(name))
    if kind == "kafka":
        return writer.format("kafka").option("kafka.bootstrap.servers", os.environ["KAFKA_BROKERS"]).option("topic", target).start()
    if kind == "files":
        return writer.format("json").option("path", target).start()
    if kind in ("memory", "console"):
        return writer.format(kind).start()
    raise ValueError(f"unknown kind of sink: {kind}")


def enrich_stream(trips: DataFrame, zones: DataFrame) -> DataFrame:
    return enrich.enrich_trips(trips, zones)


def weather_stream(trips: DataFrame, weather: DataFrame, trip_delay: str = TRIP_DELAY, weather_delay: str = WEATHER_DELAY) -> DataFrame:
    """Trips with weather: matches come at once, trips without weather when both watermarks have passed their hour."""
    return enrich.join_weather(trips, weather, trip_delay, weather_delay)


def weather_pair_stream(trips: DataFrame, weather: DataFrame, trip_delay: str = TRIP_DELAY, weather_delay: str = WEATHER_DELAY) -> DataFrame:
    """weather_stream by pairs of blocks, for hours of many observations: rows are made where they are read, by enrich.unfold_weather."""
    return enrich.pair_weather(trips, weather, trip_delay, weather_delay)


def demand_stream(trips: DataFrame, mode: str = "both_sides", delay: str = TRIP_DELAY) -> DataFrame:
    """Each window once, after the watermark has passed its end; later rows are dropped."""
    return demand.zone_demand(trips, mode=mode, delay=delay)


def flow_stream(trips: DataFrame, delay: str = TRIP_DELAY) -> DataFrame:
    return flows.od_flows(trips, delay=delay)


def start_demand(
    trips: DataFrame, baseline: DataFrame, write_demand: Callable[[DataFrame, int], None], write_alerts: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Demand and alerts from one query: state and source are kept once, and a batch goes to both writers."""

    def both(batch: DataFrame, batch_id: int) -> None:
        rated = demand.attach_baseline(batch, baseline).persist()
        try:
            write_demand(codec.demand_messages(rated), batch_id)
            write_alerts(codec.alert_messages(demand.hotspots(rated)), batch_id)
        finally:
            rated.unpersist()

    writer = demand_stream(trips).writeStream.queryName("demand").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(both).start()


PARSERS = {
    "trip_events": codec.parse_trip_events,
    "hourly_demand": codec.parse_demand,
    "hotspot_alerts": codec.parse_alerts,
    "network_flows": codec.parse_flows,
}


#: The topic of each table.
SINKS = {
    "trip_events": "ride-events-enriched",
    "hourly_demand": "demand-per-zone",
    "hotspot_alerts": "hotspot-alerts",
    "network_flows": "network-flow-updates",
}


def query_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a checkpoint keeps for its query over restarts; a new checkpoint is a new query, whose batches count from 0 again."""
    return spark.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"]


def start_sink(messages: DataFrame, table: str, store: TableStore, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Messages into a keyed table. A batch that is run again after a failure leaves the table as it is."""

    def write(rows: DataFrame, batch_id: int) -> None:
        store.write(table, rows, batch_id, query_of(rows.sparkSession, checkpoint))

    writer = PARSERS[table](messages).writeStream.queryName(f"sink_{table}").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(write).start()


def start_sinks(spark: SparkSession, store: TableStore, kind: str, locations: dict[str, str] | None = None, trigger: dict | None = None) -> list[StreamingQuery]:
    """A query for each table, from its topic or from the folder that stands for it; each with its own offsets, trigger and checkpoint."""
    started = []
    for table, topic in SINKS.items():
        place = (locations or SINKS)[table]
        messages = readers.stream_messages(spark, kind, place, readers.offsets_of("sink", topic))
        started.append(start_sink(messages, table, store, checkpoint_path(f"sink_{table}"), trigger or trigger_of("sink", table)))
    return started


def run_until_any_ends(spark: SparkSession, timeout: float | None = None) -> bool:
    """Wait for the first of the session's queries to end, by an error or by a stop; False if none has within the timeout (seconds)."""
    if timeout is None:
        spark.streams.awaitAnyTermination()
        return True
    return bool(spark.streams.awaitAnyTermination(timeout))
